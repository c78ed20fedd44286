"""DuckDB SQL of the ridge grid: fold statistics, products of terms, k-best and a Gauss-Jordan elimination.

Only the oracles of ``tune_ridge`` and ``basic_vs_enhanced`` use it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement


def grid_ctes(name: str, table: str, features: Sequence[str], y: str, group: str, folds: int, points: str,
              degree: int = 2) -> str:
    """CTEs ending in ``{name}_score (f, point, mse, r2)``.

``table`` has the features, ``y`` and ``group``; fold f is held out of groups 0..folds-1, and f = folds fits on all
    of these and is scored on group ``folds``.  ``points``: SQL of (point, degree, k, alpha, f_from, f_to)."""
    p = len(features)
    pairs = list(combinations_with_replacement(range(p), 2)) if degree > 1 else []
    total = p + len(pairs)
    t = [f"t{i}" for i in range(total)]

    def product(i, j):
        return f"sum({t[min(i, j)]} * {t[max(i, j)]})"

    gram = ", ".join("[" + ", ".join(product(i, j) for j in range(total)) + "]" for i in range(total))
    return f"""
{name}_d as (select {', '.join(f'cast({c} as double) as x{i}' for i, c in enumerate(features))}, cast({y} as double) as y,
             {group} as g from {table} src where {' and '.join(f'{c} is not null' for c in [*features, y])}),
{name}_st as (select f.range as f, {', '.join(f'avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}' for i in range(p))}
              from range({folds + 1}) f, {name}_d d where d.g <> f.range and d.g < {folds} group by f.range),
{name}_z as (select f, d.g = f as held, y, {', '.join(f'(x{i} - m{i}) / s{i} as t{i}' for i in range(p))}
             from {name}_d d, {name}_st st where d.g < {folds} or f = {folds}),
{name}_t as (select *{''.join(f', t{i} * t{j} as t{p + k}' for k, (i, j) in enumerate(pairs))} from {name}_z),
{name}_s as (select f, held, count(*) as n, sum(y) as sy, sum(y * y) as syy,
                    [{', '.join(f'sum({x})' for x in t)}] as sx, [{', '.join(f'sum({x} * y)' for x in t)}] as sxy,
                    [{gram}] as sxx from {name}_t group by f, held),
{name}_m as (select f, n, sy / n as my, list_transform(sx, lambda v: v / n) as m, sxx, sxy, syy from {name}_s where not held),
{name}_c as (select f, my, m, syy - n * my * my as yy,
                    list_transform(range(1, {total + 1}), lambda i: list_transform(range(1, {total + 1}),
                        lambda j: sxx[i][j] - n * m[i] * m[j])) as a,
                    list_transform(range(1, {total + 1}), lambda i: sxy[i] - n * m[i] * my) as b from {name}_m),
{name}_o as (select *, list_transform(list_sort(list_transform(range(1, {total + 1}), lambda i:
                    {{'c': -round(abs(b[i]) / sqrt(a[i][i] * yy), 12), 'i': i}})), lambda v: v.i) as ranked from {name}_c),
{name}_sel as (select o.*, point, alpha, list_sort(list_filter(ranked, lambda i: degree = 2 or i <= {p})[1:k]) as sel
               from {name}_o o, ({points}) p where f between f_from and f_to),
{name}_e as (
  select f, point, 1 as step, len(sel) as size, list_transform(sel, lambda i: list_concat(
           list_transform(sel, lambda j: a[i][j] + case when i = j then alpha else 0.0 end), [b[i]])) as mat from {name}_sel
  union all
  select f, point, step + 1, size, list_transform(mat, lambda r, i: case when i = step
           then list_transform(mat[step], lambda v: v / mat[step][step])
           else list_transform(r, lambda v, j: v - r[step] * mat[step][j] / mat[step][step]) end)
  from {name}_e where step <= size),
{name}_w as (select f, point, list_transform(mat, lambda r: r[size + 1]) as w from {name}_e where step = size + 1),
{name}_fit as (select w.f, w.point, w.w, sel.sel, sel.my - list_sum(list_transform(sel.sel, lambda i, k: w.w[k] * sel.m[i])) as b0
               from {name}_w w join {name}_sel sel on w.f = sel.f and w.point = sel.point),
{name}_sse as (select fit.f, point, s.n, syy - sy * sy / s.n as sst,
                      syy + s.n * b0 * b0 - 2 * b0 * sy
                      - 2 * list_sum(list_transform(sel, lambda i, k: w[k] * sxy[i]))
                      + 2 * b0 * list_sum(list_transform(sel, lambda i, k: w[k] * sx[i]))
                      + list_sum(list_transform(sel, lambda i, k: w[k] * list_sum(list_transform(sel, lambda j, l: w[l] * sxx[i][j])))) as sse
               from {name}_fit fit join {name}_s s on fit.f = s.f and s.held),
{name}_score as (select f, point, sse / n as mse, 1 - sse / sst as r2 from {name}_sse)"""


def predictions(name: str, features: Sequence[str], degree: int = 2) -> str:
    """SQL of the prediction of a row of ``{name}_t`` joined with ``{name}_fit``."""
    p = len(features)
    total = p + (p * (p + 1) // 2 if degree > 1 else 0)
    terms = ", ".join(f"t{i}" for i in range(total))
    return f"b0 + list_sum(list_transform(sel, lambda i, k: w[k] * ([{terms}])[i]))"
