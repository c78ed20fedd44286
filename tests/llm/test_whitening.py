"""Whitening against numpy on the whole fit list, exact integers and degenerate tables."""

import math
import random

import numpy as np
import pytest

from limnos.llm import queries
from limnos.llm import whitening as W


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_eigenvectors_equal_numpy(n):
    r = np.random.default_rng(n)
    kinds = [r.standard_normal((n, n)), np.diag(np.arange(n)), np.eye(n), np.zeros((n, n)), np.ones((n, n))]
    close = np.linalg.qr(r.standard_normal((n, n)))[0]
    kinds.append(close @ np.diag(np.round(np.linspace(3, 1, n)) + 1e-13 * np.arange(n)) @ close.T)
    for a in kinds:
        a = (a + a.T) / 2
        k = min(6, n)
        values, vectors = W.leading_components(a, k)
        want = np.linalg.eigvalsh(a)[::-1][:k]
        scale = max(np.abs(a).max(), 1e-300) * n
        assert np.abs(values - want).max() <= 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale


def brute(rows, k=16, scale=64):
    kept = [(i, [math.floor(scale * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    z = fit - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        out.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)),
                                      (np.array(x) - sums / n) @ vectors / np.sqrt(values)))
    return n, values / np.trace(z.T @ z / n), out


def test_rows_equal_numpy(spark):
    r = random.Random(1)
    spread = [3.0 / (k + 1) for k in range(20)]
    rows = [(k, [r.gauss(0, s) for s in spread]) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(300)]                        # a hot vector
    rows += [(None, rows[8][1]), (7, rows[9][1]), (7, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] + [0.0] * 19),
             (2004, [float("inf")] + [0.0] * 19), (2005, [1.0, 2.0])]
    rows += [(3000, [600.0] + [0.0] * 19), (3001, [2e3] + [0.0] * 19)]          # wider whole numbers
    df = spark.createDataFrame([(*x, "l", 1) for x in rows], "vec_id long, embedding array<double>, dim string, x int")
    n, share, want = brute([x for x in rows if x[0] != 2005])
    for frame in (df, df.repartition(7)):
        found, model = W.whiten(frame)
        got = {}
        for x in found.collect():
            got.setdefault(x.vec_id, []).append((x.deviation, np.array(x.whitened)))
        assert model.n == n and len(model.values) == 16
        assert np.allclose(model.explained, share, rtol=1e-9) and model.identity_error < 1e-9
        assert set(got) == set(want)
        sign = None
        for i in want:
            assert sorted(d for d, _ in got[i]) == sorted(d for d, _ in want[i])
            if len(want[i]) == 1:
                a, b = got[i][0][1], want[i][0][1]
                sign = np.sign(a * b) if sign is None else sign
                assert np.allclose(a, sign * b, atol=1e-6)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)
    found, model = W.whiten(same)
    assert model.n == 1 and [x.whitened for x in found.collect()] == [[]] * 5
    found, model = W.whiten(same.limit(0))
    assert model is None and found.count() == 0
    line = spark.createDataFrame([(k, [float(k), 0.0, 2.0 * k]) for k in range(50)], schema)
    found, model = W.whiten(line)
    assert len(model.values) == 1 and abs(model.explained[0] - 1) < 1e-12 and model.identity_error < 1e-9
    big = spark.createDataFrame([(k, [float(k) * 1e15, 1e30]) for k in range(4)], schema)
    found, model = W.whiten(big)
    assert {x.deviation for x in found.collect()} == {None}


def test_query_has_a_row_per_component(spark):
    got = queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    n, share, want = brute([(x.vec_id, x.embedding) for x in vectors])
    assert len(rows) == 16 * len(vectors) and {x.n for x in rows} == {n}
    assert all(abs(x.explained - share[x.component - 1]) < 1e-9 for x in rows)
    assert all(x.deviation == want[x.vec_id][0][0] and abs(abs(x.whitened) - abs(want[x.vec_id][0][1][x.component - 1])) < 1e-6
               for x in rows)
    assert max(x.identity_error for x in rows) < 1e-9
