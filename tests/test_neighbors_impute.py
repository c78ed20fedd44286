from conftest import frame
import numpy as np
import pandas as pd
import pytest

from limnos.operators.neighbors import knn_regress
from limnos.plans.impute import blend_weights, evaluate_imputation, fill_chained, impute, knn_k


def _brute(tr, qu, feats, k):
    X, y, keys = tr[feats].to_numpy(), tr.y.to_numpy(), tr.key.to_numpy()
    out = {}
    for _, r in qu.iterrows():
        d = np.sqrt(((X - r[feats].to_numpy(dtype=float)) ** 2).sum(1))
        o = np.lexsort((keys, np.round(d, 12)))[:k]
        dd, yy = d[o], y[o]
        out[r.qkey] = yy[dd == 0].mean() if (dd == 0).any() else (yy / dd).sum() / (1 / dd).sum()
    return out


def test_knn_exact_with_duplicates_ties_and_far_points(spark):
    rng = np.random.default_rng(11)
    n = 600
    tr = pd.DataFrame({"key": np.arange(n), "a": np.round(rng.normal(size=n), 1), "b": np.round(rng.normal(size=n), 1),
                       "y": rng.normal(size=n)})
    tr.loc[:199, ["a", "b"]] = [0.3, -0.2]  # a third of rows on one point
    qu = pd.DataFrame({"qkey": np.arange(80) + 10000, "a": np.round(rng.normal(size=80), 1),
                       "b": np.round(rng.normal(size=80), 1)})
    qu.loc[:4, ["a", "b"]] = [0.3, -0.2]
    qu.loc[5:7, ["a", "b"]] = [9.0, 9.0]
    for k in (3, 7):
        got = knn_regress(spark.createDataFrame(tr), spark.createDataFrame(qu), "key", ["a", "b"], "y", k,
                          query_key="qkey").toPandas()
        exp = _brute(tr, qu, ["a", "b"], k)
        assert len(got) == len(qu)
        assert max(abs(r.prediction - exp[r.qkey]) for r in got.itertuples()) < 1e-9


def test_zero_distance_takes_all_weight(spark):
    tr = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 100.0), (3, 2.0, 1000.0)], "key int, a double, y double")
    qu = spark.createDataFrame([(9, 0.0)], "qkey int, a double")
    r = knn_regress(tr, qu, "key", ["a"], "y", 3, query_key="qkey").collect()[0]
    assert r["prediction"] == 10.0


def test_blend_bands_and_k():
    assert blend_weights(0.6, ["rf", "knn"]) == pytest.approx({"rf": 0.4 / 0.6, "knn": 0.2 / 0.6})
    assert blend_weights(0.3, ["knn", "iterative"]) == pytest.approx({"knn": 0.25 / 0.35, "iterative": 0.1 / 0.35})
    assert blend_weights(0.1, ["knn", "mean"]) == pytest.approx({"knn": 0.4 / 0.65, "mean": 0.25 / 0.65})
    assert (knn_k(5), knn_k(100), knn_k(1000)) == (3, 10, 20)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(4)
    n = 300
    t = rng.normal(15, 3, n)
    do = 14 - 0.35 * t + rng.normal(0, 0.3, n)
    ph = 7.5 + 0.05 * do + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "water_temp_celcius": t, "doxy_mg_L": do, "pH": ph})
    for c, frac in [("water_temp_celcius", 0.1), ("doxy_mg_L", 0.3), ("pH", 0.6)]:
        pdf.loc[rng.random(n) < frac, c] = None
    return pdf, frame(spark, pdf)


def test_impute_fills_only_gaps(gappy):
    pdf, df = gappy
    out = impute(df, "row_id", methods=("knn", "iterative", "gbm"), gbm_params={"max_iter": 10},
                 mice_estimator="bayesian_ridge").toPandas()
    out = out.set_index("row_id").loc[pdf.row_id]
    for c in ["water_temp_celcius", "doxy_mg_L", "pH"]:
        assert out[c].isna().sum() == 0
        obs = pdf[c].notna().to_numpy()
        assert np.array_equal(out[c].to_numpy()[obs], pdf[c].to_numpy()[obs])
        filled = out[c].to_numpy()[~obs]
        assert np.allclose(filled, np.round(filled, 2))
        lo, hi = np.nanpercentile(pdf[c], [1, 99])
        assert filled.min() >= lo - 1e-9 and filled.max() <= hi + 1e-9


def test_chained_equations_recover_relation(gappy):
    pdf, df = gappy
    out = fill_chained(df, ["water_temp_celcius", "doxy_mg_L"], rounds=5, estimator="bayesian_ridge").toPandas()
    miss = out["doxy_mg_L"].isna() & out["water_temp_celcius"].notna()
    pred = out.loc[miss, "doxy_mg_L__iterative"]
    exp = 14 - 0.35 * out.loc[miss, "water_temp_celcius"]
    assert np.mean(np.abs(pred - exp)) < 0.3


def test_chained_boosting(gappy):
    pdf, df = gappy
    out = fill_chained(df, ["water_temp_celcius", "doxy_mg_L"], rounds=1, gbm_params={"max_iter": 4, "step_size": 0.5}).toPandas()
    assert len(out) == len(pdf) and out.loc[out["doxy_mg_L"].isna(), "doxy_mg_L__iterative"].notna().all()


def test_evaluate_imputation_rows(gappy):
    _, df = gappy
    ev = evaluate_imputation(df, "row_id", ["water_temp_celcius", "doxy_mg_L"], methods=("knn", "iterative"),
                             per_method=True, mice_estimator="bayesian_ridge")
    rows = ev.collect()
    assert {r["method"] for r in rows} == {"blend", "knn", "iterative"}
    do_iter = [r for r in rows if r["target"] == "doxy_mg_L" and r["method"] == "iterative"][0]
    assert do_iter["r2"] > 0.5


def test_knn_exact_in_six_dimensions_with_constant_leading_features(spark):
    rng = np.random.default_rng(17)
    n = 500
    cols = ["c1", "c2", "a", "b", "c", "d"]
    tr = pd.DataFrame({"key": np.arange(n), "c1": 0.0, "c2": np.where(rng.random(n) < 0.9, 0.0, 1.0),
                       "a": rng.normal(size=n), "b": rng.normal(size=n), "c": np.round(rng.normal(size=n), 1),
                       "d": rng.normal(size=n), "y": rng.normal(size=n)})
    qu = pd.DataFrame({"qkey": np.arange(60) + 10000, "c1": 0.0, "c2": 0.0, "a": rng.normal(size=60),
                       "b": rng.normal(size=60), "c": rng.normal(size=60), "d": rng.normal(size=60)})
    got = knn_regress(spark.createDataFrame(tr), spark.createDataFrame(qu), "key", cols, "y", 5,
                      query_key="qkey").toPandas()
    exp = _brute(tr, qu, cols, 5)
    assert len(got) == 60 and max(abs(r.prediction - exp[r.qkey]) for r in got.itertuples()) < 1e-9


def test_report_has_densities_and_importances(spark):
    from limnos.plans.impute import imputation_report
    rng = np.random.default_rng(12)
    n = 300
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"k": [str(i) for i in range(n)], "a": a, "b": 2 * a + 0.1 * rng.normal(size=n), "c": rng.normal(size=n)})
    pdf.loc[rng.choice(n, 60, replace=False), "b"] = np.nan
    out = imputation_report(frame(spark, pdf), "k", ["b"], methods=("rf", "mean"), rf_params={"num_trees": 10}, points=60)
    scores = {r.method: r.r2 for r in out["metrics"].collect()}
    assert scores["rf"] > 0.8 > scores["mean"]
    dens = out["densities"].toPandas()
    assert {(m, k) for m, k in zip(dens.method, dens.kind)} == {("observed", "observed")} | {
        (m, k) for m in ("blend", "rf", "mean") for k in ("imputed", "error")}
    for _, part in dens.groupby(["method", "kind"]):
        part = part.sort_values("x")
        assert len(part) == 60 and abs(np.trapezoid(part.density, part.x) - 1) < 0.02
    imp = {(r.method, r.feature): r.importance for r in out["importances"].collect()}
    assert imp["rf", "a"] > 0.9 and ("mean", "a") not in imp


def test_fills_of_rows_are_not_broadcast(spark):
    """A fill has a row per gap: it is joined by sorting, also where it is still small."""
    from limnos.plans.impute import impute

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=[f"r{i}" for i in range(400)])
    pdf.loc[::4, "a"] = np.nan
    out = impute(frame(spark, pdf), "id", ["a"], methods=("knn", "rf", "iterative", "mean"), mice_estimator="linear", mice_rounds=2,
                 rf_params={"num_trees": 5, "max_depth": 4})
    rows = out.toPandas()
    assert len(rows) == 400 and rows["a"].notna().all()
    hints = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in hints.splitlines() if "Join LeftOuter" in x and "_row_id" in x]
    assert len(joins) == 3 and all("strategy=merge" in x for x in joins)


def test_forest_fills_write_no_trees(spark):
    import os

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": [str(i) for i in range(300)], "a": rng.normal(0, 1, 300)}).assign(b=lambda d: 2 * d["a"] + rng.normal(0, 0.1, 300))
    pdf.loc[::4, "b"] = np.nan
    models = {}
    out = impute(frame(spark, pdf), "k", ["b"], methods=("rf",), rf_params={"num_trees": 5}, models_out=models)
    assert out.where("b is null").count() == 0
    forest_ = models[("rf", "b")].model
    assert abs(sum(forest_.importances) - 1) < 1e-9 and not os.path.exists(forest_.path)
