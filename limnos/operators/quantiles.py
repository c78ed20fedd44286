"""Exact quantiles (linear interpolation) without an unbounded merge.

Spark's exact ``percentile`` keeps a value->count map per task and merges
every map in one final task: with a continuous column at 100 TB that is
the whole column in one task.  Here the exact value at each required rank
is found by *selection*:

1. one pass: ``count`` and ``percentile_approx`` candidates around each
   target probability (the sketch is bounded by ``accuracy``);
2. one pass: exact ``count_if(c < v)`` / ``count_if(c <= v)`` for every
   candidate.  A candidate with ``lt <= rank < le`` *is* the value at that
   rank (this is how a hot value holding a third of the rows resolves at
   once); otherwise the candidates bracket the rank;
3. once a bracket holds at most ``small_bracket`` rows its values are
   gathered with ``sort_array(collect_list(...))`` -- bounded by the check
   -- and indexed; larger brackets repeat steps 1-2 inside the bracket.

Each pass is a global aggregate with map-side partial aggregation, so the
shuffle is one row per task.  Results are plain floats (one-row
statistics) and are used as literals, which lets Catalyst fold them and
push range filters into the Parquet scan.

Interpolation follows the linear rule of NumPy / DuckDB ``quantile_cont``:
``h = (n - 1) p``, ``v = x[floor h] + (h - floor h) (x[ceil h] - x[floor h])``.
The input is expected NaN-free (see ``nan_to_null``); NULLs are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10000
SMALL_BRACKET = 200_000


class _Target:
    __slots__ = ("col", "rank", "lo", "le_lo", "hi", "lt_hi", "value")

    def __init__(self, col: str, rank: int, n: int):
        self.col = col
        self.rank = rank          # 0-based rank in ascending order
        self.lo = None            # exclusive lower bound value (None = -inf)
        self.le_lo = 0            # rows <= lo
        self.hi = None            # exclusive upper bound value (None = +inf)
        self.lt_hi = n            # rows < hi
        self.value = None

    def in_bracket(self):
        c = F.col(self.col)
        cond = c.isNotNull()
        if self.lo is not None:
            cond = cond & (c > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c < F.lit(self.hi))
        return cond

    @property
    def size(self) -> int:
        return self.lt_hi - self.le_lo


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _candidate_probs(rel: float, accuracy: int) -> list[float]:
    delta = 3.0 / accuracy
    return sorted({min(1.0, max(0.0, rel - delta)), min(1.0, max(0.0, rel)),
                   min(1.0, max(0.0, rel + delta))})


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY, small_bracket: int = SMALL_BRACKET,
                    max_rounds: int = 16, persist: bool = True) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each column at each probability.

    Returns ``{col: [q(p) for p in probs]}``; an all-NULL column gives NaNs.
    With ``persist`` the projected columns are kept (memory, spilling to
    disk) for the 3+ passes, so an expensive upstream plan runs once.
    """
    return quantiles_with_stats(df, cols, probs, [], accuracy=accuracy, small_bracket=small_bracket,
                                max_rounds=max_rounds, persist=persist)[0]


def quantiles_with_stats(df: DataFrame, cols: Sequence[str], probs: Sequence[float], stats: Sequence,
                         accuracy: int = DEFAULT_ACCURACY, small_bracket: int = SMALL_BRACKET,
                         max_rounds: int = 16, persist: bool = True, exact: bool = True):
    """Quantiles plus extra one-row aggregates (``stats``, aliased Columns over
    ``df``'s columns) computed in the selection's first pass -- one scan fewer
    than a separate aggregate.  Returns (quantiles dict, stats Row)."""
    cols = list(cols)
    probs = [float(p) for p in probs]
    stats = list(stats)
    if not exact:
        aggs = [F.percentile_approx(F.col(_q(c)), probs, accuracy).alias(f"a{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs, *stats).collect()[0]
        qs = {c: [float(v) if v is not None else float("nan") for v in (row[f"a{i}"] or [None] * len(probs))]
              for i, c in enumerate(cols)}
        return qs, row
    if not cols:
        return {}, (df.agg(*stats).collect()[0] if stats else None)
    data = df if stats else df.select(*[F.col(_q(c)) for c in cols])
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select(data, cols, probs, accuracy, small_bracket, max_rounds, stats)
    finally:
        if persist:
            data.unpersist()


def _select(data: DataFrame, cols: list[str], probs: list[float], accuracy: int, small_bracket: int,
            max_rounds: int, stats: Sequence = ()):

    # pass 1: counts plus first candidates at the target probabilities
    first_probs = sorted({p2 for p in probs for p2 in _candidate_probs(p, accuracy)})
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(_q(c))).alias(f"n{i}"))
        aggs.append(F.percentile_approx(F.col(_q(c)), first_probs, accuracy).alias(f"a{i}"))
    row = data.agg(*aggs, *stats).collect()[0]

    counts = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    targets: dict[tuple[str, int], _Target] = {}
    candidates: dict[tuple[str, int], list[float]] = {}
    for i, c in enumerate(cols):
        n = counts[c]
        if n == 0:
            continue
        by_prob = dict(zip(first_probs, row[f"a{i}"] or []))
        for p in probs:
            h = (n - 1) * p
            for r in {int(math.floor(h)), int(math.ceil(h))}:
                if (c, r) in targets:
                    continue
                targets[(c, r)] = _Target(c, r, n)
                candidates[(c, r)] = sorted({float(by_prob[q]) for q in _candidate_probs(p, accuracy)
                                             if by_prob.get(q) is not None})

    for _ in range(max_rounds):
        open_targets = [k for k, t in targets.items() if t.value is None]
        if not open_targets:
            break
        # pass 2: verify candidates with exact counts
        exprs, index = [], []
        for k in open_targets:
            for v in candidates.get(k, []):
                t = targets[k]
                c = F.col(_q(t.col))
                j = len(index)
                exprs.append(F.count_if(c < F.lit(v)).alias(f"lt{j}"))
                exprs.append(F.count_if(c <= F.lit(v)).alias(f"le{j}"))
                index.append((k, v))
        if exprs:
            crow = data.agg(*exprs).collect()[0]
            for j, (k, v) in enumerate(index):
                t = targets[k]
                if t.value is not None:
                    continue
                lt, le = int(crow[f"lt{j}"]), int(crow[f"le{j}"])
                if lt <= t.rank < le:
                    t.value = v
                elif le <= t.rank:
                    if t.lo is None or v > t.lo:
                        t.lo, t.le_lo = v, le
                elif lt > t.rank:
                    if t.hi is None or v < t.hi:
                        t.hi, t.lt_hi = v, lt
        open_targets = [k for k, t in targets.items() if t.value is None]
        if not open_targets:
            break
        # pass 3: gather small brackets (size proven <= small_bracket), refine the rest
        small = [k for k in open_targets if targets[k].size <= small_bracket]
        large = [k for k in open_targets if targets[k].size > small_bracket]
        aggs = []
        for j, k in enumerate(small):
            t = targets[k]
            aggs.append(F.sort_array(F.collect_list(F.when(t.in_bracket(), F.col(_q(t.col)))))
                        .alias(f"s{j}"))
        for j, k in enumerate(large):
            t = targets[k]
            rel = (t.rank - t.le_lo + 0.5) / t.size
            aggs.append(F.percentile_approx(F.when(t.in_bracket(), F.col(_q(t.col))),
                                            _candidate_probs(rel, accuracy), accuracy).alias(f"r{j}"))
        arow = data.agg(*aggs).collect()[0]
        for j, k in enumerate(small):
            t = targets[k]
            vals = arow[f"s{j}"]
            t.value = float(vals[t.rank - t.le_lo])
        candidates = {}
        for j, k in enumerate(large):
            vals = arow[f"r{j}"] or []
            candidates[k] = sorted({float(v) for v in vals if v is not None})
    else:
        raise RuntimeError("exact_quantiles did not converge")

    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = counts[c]
        res = []
        for p in probs:
            if n == 0:
                res.append(float("nan"))
                continue
            h = (n - 1) * p
            lo_r, hi_r = int(math.floor(h)), int(math.ceil(h))
            lo_v, hi_v = targets[(c, lo_r)].value, targets[(c, hi_r)].value
            res.append(lo_v + (h - lo_r) * (hi_v - lo_v))
        out[c] = res
    return out, row


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float | None]]:
    """One-pass sketch quantiles (rank error <= n / accuracy)."""
    aggs = [F.percentile_approx(F.col(_q(c)), list(probs), accuracy).alias(f"a{i}")
            for i, c in enumerate(cols)]
    row = df.agg(*aggs).collect()[0]
    return {c: [float(v) if v is not None else float("nan") for v in (row[f"a{i}"] or [None] * len(probs))]
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles by exact selection (default) or by one sketch pass."""
    if exact:
        return exact_quantiles(df, cols, probs, accuracy=accuracy)
    return approx_quantiles(df, cols, probs, accuracy=accuracy)


def grouped_kth_smallest(data: DataFrame, group: str, value: str, k: int, n_groups: int,
                         accuracy: int = DEFAULT_ACCURACY, small_bracket: int = SMALL_BRACKET,
                         sketch_points: int = 200, max_rounds: int = 16) -> list[float | None]:
    """Exact k-th smallest ``value`` (1-based) in every group 0..n_groups-1.

    ``group`` is an integer id in [0, n_groups); ``n_groups`` is small (a
    grid).  Same selection as ``exact_quantiles``, for all groups per pass:
    a sketch (``percentile_approx`` at ``sketch_points`` fixed probabilities
    inside each group's bracket) proposes candidates, exact grouped
    ``count_if`` verifies them, and brackets proven to hold at most
    ``small_bracket`` values are gathered and indexed.  Per-group bounds
    travel as literal arrays indexed by the group id (no join).
    """
    g = F.col(_q(group))
    gi = g.cast("int") + 1  # 1-based array position of the group
    v = F.col(_q(value))
    inf = float("inf")
    lo = [-inf] * n_groups
    hi = [inf] * n_groups
    le_lo = [0] * n_groups
    counts = {r[0]: int(r[1]) for r in data.groupBy(g).agg(F.count(v)).collect()}
    lt_hi = [counts.get(i, 0) for i in range(n_groups)]
    res: list[float | None] = [None] * n_groups
    open_g = [i for i in range(n_groups) if counts.get(i, 0) >= k]

    def arr(xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    def bracket_cond():
        return (v > F.element_at(arr(lo), gi)) & (v < F.element_at(arr(hi), gi))

    probs = [i / (sketch_points - 1) for i in range(sketch_points)]
    for _ in range(max_rounds):
        open_g = [i for i in open_g if res[i] is None]
        if not open_g:
            break
        small = [i for i in open_g if lt_hi[i] - le_lo[i] <= small_bracket]
        large = [i for i in open_g if i not in small]
        aggs = []
        if small:
            aggs.append(F.sort_array(F.collect_list(F.when(bracket_cond(), v))).alias("vals"))
        if large:
            aggs.append(F.percentile_approx(F.when(bracket_cond(), v), probs, accuracy).alias("sk"))
        rows = {r[0]: r for r in data.where(g.isin(open_g)).groupBy(g).agg(*aggs).collect()}
        cands: dict[int, list[float]] = {}
        for i in small:
            vals = rows[i]["vals"] if i in rows else []
            res[i] = float(vals[k - le_lo[i] - 1])
        for i in large:
            sk = [float(x) for x in (rows[i]["sk"] or [])] if i in rows else []
            size = lt_hi[i] - le_lo[i]
            rel = (k - le_lo[i] - 0.5) / size
            j = min(len(sk) - 1, max(0, int(rel * (len(sk) - 1))))
            cands[i] = sorted({sk[max(0, j - 1)], sk[j], sk[min(len(sk) - 1, j + 1)]}) if sk else []
        if not cands:
            continue
        width = max(len(c) for c in cands.values())
        exprs = []
        for j in range(width):
            cj = [cands.get(i, [0.0])[min(j, len(cands.get(i, [0.0])) - 1)] for i in range(n_groups)]
            cv = F.element_at(arr(cj), gi)
            exprs += [F.count_if(v < cv).alias(f"lt{j}"), F.count_if(v <= cv).alias(f"le{j}")]
        crows = {r[0]: r for r in data.where(g.isin(list(cands))).groupBy(g).agg(*exprs).collect()}
        for i, cl in cands.items():
            r = crows[i]
            for j, cval in enumerate(cl):
                lt, le = int(r[f"lt{j}"]), int(r[f"le{j}"])
                if lt < k <= le:
                    res[i] = cval
                    break
                if le < k and cval > lo[i]:
                    lo[i], le_lo[i] = cval, le
                elif lt >= k and cval < hi[i]:
                    hi[i], lt_hi[i] = cval, lt
    return res
