"""Odd inputs of imputation, kNN, scoring and ranks: keys that are null or repeated, few rows, missing features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators.metrics import gaussian_nll
from limnos.operators.neighbors import knn_regress
from limnos.operators.ranking import rank_within_groups
from limnos.operators.reshape import pivot_wide
from limnos.operators.smooth import kde_grid
from limnos.plans.impute import blend, evaluate_imputation, fill_chained, impute


def rows_of(n, seed=1, dims=5):
    r = np.random.default_rng(seed)
    return [(i, *map(float, r.normal(size=dims)), float(r.normal())) for i in range(n)]


def brute(train, q, k):
    d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(t[1:-1], q)))), t[0], t[-1]) for t in train)[:k]
    return sum(y / x for x, _, y in d) / sum(1 / x for x, _, y in d), len(d)


def test_knn_beyond_gridded_features(spark):
    feats = [f"x{i}" for i in range(5)]
    train = rows_of(60)
    q = [(1, 0.0, 0.0, 0.0, 0.0, 50.0), (2, 90.0, 0.0, 0.1, 0.0, 0.0), (None, 0.1, 0.2, 0.3, 0.4, 0.5), (1, 0.3, 0.2, 0.1, 0.0, 0.1)]
    tr = spark.createDataFrame(train, "k long, " + ", ".join(f"{f} double" for f in feats) + ", y double")
    qu = spark.createDataFrame(q, "k long, " + ", ".join(f"{f} double" for f in feats))
    got = knn_regress(tr, qu, "k", feats, "y", 5).collect()
    want = sorted((str(x[0]), round(brute(train, x[1:], 5)[0], 8), 5) for x in q)
    assert sorted((str(r["k"]), round(r["prediction"], 8), r["n_neighbors"]) for r in got) == want
    few = knn_regress(tr.limit(3), qu, "k", feats, "y", 5).collect()
    assert [r["n_neighbors"] for r in few] == [3, 3, 3, 3]


def test_impute_null_and_repeated_keys(spark):
    r = np.random.default_rng(2)
    rows = [(None if i < 10 else i // 2, float(r.normal()), None if i % 4 == 0 else float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = impute(df, "k", ["b"], methods=("knn", "mean")).collect()
    assert len(out) == 80 and all(x["b"] is not None for x in out)
    assert sorted((str(x["k"]), x["a"]) for x in out) == sorted((str(k), a) for k, a, _ in rows)


def test_chained_linear_recovers_and_is_not_clipped(spark):
    a = np.linspace(0, 1, 400)
    df = spark.createDataFrame([(i, float(x), None if x >= 0.5 else float(3 * x)) for i, x in enumerate(a)],
                               "k long, a double, b double")
    got = fill_chained(df, ["a", "b"], estimator="linear", ridge=1e-12).where("b IS NULL").collect()
    assert max(abs(x["b__iterative"] - 3 * x["a"]) for x in got) < 1e-6
    bounded = fill_chained(df, ["a", "b"], estimator="linear", clip_to_observed=True).where("b IS NULL")
    assert bounded.agg(F.max("b__iterative")).first()[0] <= 1.5


def test_blend_shares_out_missing_predictions(spark):
    df = spark.createDataFrame([(None, 2.0, None), (None, 2.0, 4.0), (None, None, None), (7.0, None, None)],
                               "t double, t__rf double, t__knn double")
    got = [x["t"] for x in blend(df, "t", ["rf", "knn"], 0.1, None).collect()]
    assert got[0] == 2.0 and 2.0 < got[1] < 4.0 and got[2] is None and got[3] == 7.0


def test_evaluate_without_targets_is_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k long, b double")
    assert evaluate_imputation(df, "k", ["b"], methods=("mean",)).count() == 0


def test_nll_uses_one_set_of_rows(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (9.0, 0.0, None)], "y double, m double, v double")
    row = gaussian_nll(df, "y", "m", "v").first()
    assert row["n"] == 1 and row["mean_mse"] == 1.0


def test_pivot_keeps_null_level(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 3.0)], "id long, v string, x double")
    assert pivot_wide(df, ["id"], "v", "x").first().asDict() == {"id": 1, "a": 1.0, "null": 3.0}


def test_kde_sums_every_term(spark):
    x = [0.0, 1.0, 100.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = kde_grid(df, "x", points=11, bandwidth=2.0, digits=None).orderBy("idx").collect()
    want = [sum(np.exp(-0.5 * ((r["x"] - v) / 2) ** 2) for v in x) / (3 * 2 * np.sqrt(2 * np.pi)) for r in got]
    assert np.allclose([r["density"] for r in got], want, rtol=1e-12, atol=0)


def test_scattered_ids_need_no_window(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("k"))
    ranked = rank_within_groups(df, "g", "k")
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    rows = ranked.orderBy("k").collect()
    assert [r["rn"] for r in rows] == list(range(1, 3001))


def test_gaussian_model_round_trip(spark, tmp_path):
    from limnos.plans.models import load_gaussian, save_gaussian, train_gaussian
    from limnos.plans.score import score_batch
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), float(2 * x + r.normal())) for x in r.normal(size=200)], "x double, y double")
    gm = train_gaussian(df, ["x"], "y", mean_kind="linear")
    save_gaussian(gm, f"{tmp_path}/gm")
    test = spark.createDataFrame([(0.5,), (None,)], "x double")
    a, b = (score_batch(m, test).collect() for m in (gm, load_gaussian(f"{tmp_path}/gm")))
    assert a == b and a[0]["DO_Uncertainty"] > 0
    assert [a[1][c] for c in ("DO_Predicted", "DO_Uncertainty", "DO_LowerCI", "DO_UpperCI")] == [None] * 4


def test_permutation_needs_the_same_rows(spark):
    from limnos.plans.models import permute_column
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "k long, x double")
    out = permute_column(df, "x", "k").collect()
    assert sorted(r["x"] for r in out) == [float(i) for i in range(200)] and sorted(r["k"] for r in out) == list(range(200))
    assert any(r["x"] != r["k"] for r in out)
