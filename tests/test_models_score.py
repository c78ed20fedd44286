from conftest import frame
import math

import numpy as np
import pandas as pd
import pytest

from limnos.operators.metrics import calibration_table, regression_metrics
from limnos.plans.models import (coefficient_table, load_model, original_scale_coefficients, save_model, train,
                                 train_gaussian)
from limnos.plans.score import (fit_ols_closed_form, predict_interval, prediction_surface, residual_interval, score,
                                score_batch, score_with_temperature)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 400
    x1, x2 = rng.normal(10, 2, n), rng.normal(0, 1, n)
    y = 3.0 + 2.0 * x1 - 1.5 * x2 + rng.normal(0, 0.5 + 0.1 * np.abs(x1 - 10), n)
    pdf = pd.DataFrame({"k": np.arange(n), "x1": x1, "x2": x2, "y": y})
    return pdf, frame(spark, pdf)


def test_ols_and_ridge_match_closed_form(data):
    pdf, df = data
    X = pdf[["x1", "x2"]].to_numpy()
    Z = (X - X.mean(0)) / X.std(0)
    Zc, yc = Z - Z.mean(0), pdf.y.to_numpy() - pdf.y.mean()
    for kind, alpha in [("linear", 0.0), ("ridge", 5.0)]:
        tm = train(df, ["x1", "x2"], "y", kind, alpha=alpha)
        w = np.linalg.solve(Zc.T @ Zc + alpha * np.eye(2), Zc.T @ yc)
        assert np.allclose(tm.regressor.coefficients.toArray(), w, rtol=1e-8)
    coefs = original_scale_coefficients(train(df, ["x1", "x2"], "y", "linear"))
    cf = fit_ols_closed_form(df, ["x1", "x2"], "y")
    for k in cf:
        assert math.isclose(coefs[k], cf[k], rel_tol=1e-8, abs_tol=1e-9)


def test_trees_beat_mean_predictor(data):
    _, df = data
    for kind in ["random_forest", "gbm"]:
        tm = train(df, ["x1", "x2"], "y", kind, num_trees=20, max_iter=20)
        r2 = regression_metrics(tm.transform(df), "y", "prediction").collect()[0]["r2"]
        assert r2 > 0.5


def test_save_load_roundtrip(data, tmp_path):
    _, df = data
    tm = train(df, ["x1", "x2"], "y", "polynomial")
    save_model(tm, str(tmp_path / "m"), {"r2": 0.9})
    back = load_model(str(tmp_path / "m"))
    a = tm.transform(df).select("k", "prediction").orderBy("k").collect()
    b = back.transform(df).select("k", "prediction").orderBy("k").collect()
    assert a == b and back.features == ["x1", "x2"]
    assert coefficient_table(tm).count() == 6  # 5 terms + intercept


def test_gaussian_model_intervals(data):
    _, df = data
    gm = train_gaussian(df, ["x1", "x2"], "y", mean_kind="linear")
    out = score_batch(gm, df.withColumnRenamed("x1", "chl"), roles={"x1": "chl"}).collect()
    assert "chl" in out[0].asDict() and "x1" not in out[0].asDict()
    for r in out:
        assert r["DO_LowerCI"] <= r["DO_Predicted"] <= r["DO_UpperCI"]
        assert r["DO_Uncertainty"] >= 0.01 * abs(r["DO_Predicted"]) - 1e-12


def test_predict_interval_floor_and_eval_mode(spark):
    df = spark.createDataFrame([(100.0, math.log(1e-6))], "mu double, lv double")
    r = predict_interval(df, "mu", "lv").collect()[0]
    assert math.isclose(r["pred_sigma"], 1.0) and math.isclose(r["pred_upper"], 101.96)
    r0 = predict_interval(df, "mu", "lv", min_rel_sigma=0).collect()[0]
    assert r0["pred_sigma"] < 0.01


def test_null_features_pass_through(data, spark):
    _, df = data
    tm = train(df, ["x1", "x2"], "y", "linear")
    probe = spark.createDataFrame([(1, None, 0.0), (2, 10.0, 0.0)], "k int, x1 double, x2 double")
    r = {row["k"]: row["prediction"] for row in score(tm, probe).collect()}
    assert r[1] is None and r[2] is not None
    sites = spark.createDataFrame([(1, "d1"), (2, "d2")], "site int, day string")
    temps = spark.createDataFrame([(1, "d1", 12.0), (1, "d1", 14.0)], "site int, day string, ts_celsius double")
    coefs = {"(intercept)": 1.0, "temp": 0.5}
    out = {r["site"]: r for r in score_with_temperature(coefs, sites, temps, ["site", "day"], offset=1.0).collect()}
    assert out[1]["surface_temp"] == 12.0 and out[1]["predicted_do"] == 7.0
    assert out[2]["surface_temp"] is None and out[2]["predicted_do"] is None


def test_residual_interval_and_surface(data):
    _, df = data
    coefs = fit_ols_closed_form(df, ["x1", "x2"], "y")
    scored = score(coefs, df)
    out = residual_interval(scored, "y", "prediction", k=2.0).collect()
    width = out[0]["upper"] - out[0]["lower"]
    assert all(math.isclose(r["upper"] - r["lower"], width) for r in out)
    surf = prediction_surface(coefs, df, "x1", "x2", levels=3)
    assert surf.count() == 3 and surf.columns == ["x1", "x2_0", "x2_1", "x2_2"]


def test_calibration_includes_max(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(1, 21)], "s double, e double")
    t = {r["bin"]: r["n"] for r in calibration_table(df, "s", "e", bins=10).collect()}
    assert sum(t.values()) == 20 and max(t) == 10
    t2 = calibration_table(df, "s", "e", bins=10, include_max=False).collect()
    assert sum(r["n"] for r in t2) == 19


def test_bayesian_ridge_shrinks_noise_not_signal(spark):
    from limnos.plans.score import fit_bayesian_ridge
    rng = np.random.default_rng(9)
    n = 2000
    X = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": 3.0 * X[:, 0] + rng.normal(size=n)})
    c = fit_bayesian_ridge(frame(spark, pdf), ["a", "b"], "y")
    assert abs(c["a"] - 3.0) < 0.1 and abs(c["b"]) < 0.1
    ols = fit_ols_closed_form(frame(spark, pdf), ["a", "b"], "y")
    assert abs(c["a"] - ols["a"]) < 0.01


def test_permutation_is_a_permutation_and_importance_ranks_signal(data, spark):
    from limnos.plans.models import permutation_importance, permute_column
    _, df = data
    perm = permute_column(df, "x1", "k").select("k", "x1").toPandas()
    assert len(perm) == df.count() and sorted(perm.x1) == sorted(df.toPandas().x1)
    assert (perm.sort_values("k").x1.to_numpy() != df.toPandas().sort_values("k").x1.to_numpy()).mean() > 0.9
    tm = train(df, ["x1", "x2"], "y", "linear")
    imp = permutation_importance(tm, df, "k").collect()
    assert imp[0]["feature"] == "x1" and imp[0]["mse_increase"] > imp[1]["mse_increase"] > 0


def test_enrich_rounds_float_keys_and_dedupes(spark):
    from limnos.operators.joins import enrich_left_join
    sites = spark.createDataFrame([(1, 45.123, -63.456, "d1"), (2, 10.0, 10.0, "d1")],
                                  "site int, lat double, lon double, day string")
    temps = spark.createDataFrame([(45.1201, -63.4599, "d1", 10.0), (45.1249, -63.4551, "d1", 14.0)],
                                  "lat double, lon double, day string, ts_celsius double")
    out = {r["site"]: r for r in enrich_left_join(sites, temps, ["lat", "lon", "day"], ["ts_celsius"],
                                                   round_keys={"lat": 2, "lon": 2}).collect()}
    assert len(out) == 2 and out[1]["ts_celsius"] == 12.0 and out[2]["ts_celsius"] is None
    assert out[1]["lat"] == 45.123  # the left row keeps its own coordinates


def test_variance_model_recovers_known_log_variance_slope(spark):
    rng = np.random.default_rng(21)
    n = 4000
    x = rng.uniform(0, 4, n)
    sd = np.exp(0.5 * (-1.0 + 0.8 * x))  # log variance = -1 + 0.8 x
    pdf = pd.DataFrame({"x": x, "y": 2.0 + 1.5 * x + rng.normal(size=n) * sd})
    gm = train_gaussian(frame(spark, pdf), ["x"], "y", mean_kind="linear")
    out = gm.transform(frame(spark, pdf)).select("x", "logvar").toPandas()
    slope = np.polyfit(out.x, out.logvar, 1)[0]
    assert 0.6 < slope < 1.0


def test_additive_hinge_model_beats_linear_on_a_curve(spark):
    from limnos.plans.models import adjusted_r2, hinge_basis
    rng = np.random.default_rng(13)
    n = 1500
    x = rng.uniform(0, 6, n)
    pdf = pd.DataFrame({"x": x, "y": np.sin(x) * 3 + rng.normal(0, 0.3, n)})
    df = frame(spark, pdf)
    lin = train(df, ["x"], "y", "linear")
    r2_lin = regression_metrics(lin.transform(df), "y", "prediction").collect()[0]["r2"]
    based, names = hinge_basis(df, ["x"], knots=5)
    add = train(based, ["x", *names], "y", "ridge", alpha=1.0)
    r2_add = regression_metrics(add.transform(based), "y", "prediction").collect()[0]["r2"]
    assert len(names) == 5 and r2_add > r2_lin + 0.3
    assert adjusted_r2(r2_add, n, 6) < r2_add
