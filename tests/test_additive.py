"""Additive smooths against a dense mixed model: basis, fit, chosen smoothness and scoring."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.plans.additive import fit_additive, spline_basis


def cox_de_boor(x, lo, hi, basis):
    """B-splines by the recursion over degrees."""
    h = (hi - lo) / (basis - 3)
    knots = lo + h * np.arange(-3, basis + 1)
    b = np.stack([(knots[i] <= x) & (x < knots[i + 1]) for i in range(len(knots) - 1)], axis=1).astype(float)
    for d in (1, 2, 3):
        b = np.stack([(x - knots[i]) / (d * h) * b[:, i] + (knots[i + d + 1] - x) / (d * h) * b[:, i + 1]
                      for i in range(b.shape[1] - 1)], axis=1)
    return b[:, :basis]


def test_basis_is_the_recursions():
    x = np.linspace(2, 5, 200)[:-1]
    assert np.allclose(spline_basis(x, 2, 5, 9), cox_de_boor(x, 2, 5, 9))
    assert np.allclose(spline_basis(np.array([2, 5, 9.0]), 2, 5, 9).sum(axis=1), 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.random(150), "b c": rng.normal(0, 2, 150)})
    pdf["y"] = 5 + np.sin(7 * pdf["a"]) + 0.3 * pdf["b c"] + rng.normal(0, 0.3, 150)
    pdf["id"] = np.arange(150)
    return frame(spark, pdf).cache(), pdf


def dense(pdf, basis):
    """Fixed part (constant and lines) and one covariance per smooth: penalised coefficients are random effects."""
    d = np.diff(np.eye(basis), 2, axis=0)
    parts = [spline_basis(pdf[c].to_numpy(), pdf[c].min(), pdf[c].max(), basis) for c in ("a", "b c")]
    fixed = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b c"]])
    return fixed, [p @ np.linalg.pinv(d.T @ d) @ p.T for p in parts]


def restricted(logs, fixed, covs, y):
    v = np.eye(len(y)) + sum(np.exp(t) * c for t, c in zip(logs, covs, strict=True))
    vi = np.linalg.inv(v)
    inner = fixed.T @ vi @ fixed
    p = vi - vi @ fixed @ np.linalg.solve(inner, fixed.T @ vi)
    return (np.linalg.slogdet(v)[1] + np.linalg.slogdet(inner)[1] + (len(y) - fixed.shape[1]) * np.log(y @ p @ y)) / 2, p, v


def test_reml_is_that_of_the_mixed_model(spark, data):
    df, pdf = data
    model = fit_additive(df, ["a", "b c"], "y")
    fixed, covs = dense(pdf, 10)
    y = pdf["y"].to_numpy()
    # the fit's own penalties are scaled by traces: look for the smoothness on a fine grid of the dense criterion
    grid = np.linspace(-14, 8, 23)
    best = min((restricted((s, t), fixed, covs, y)[0], s, t) for s in grid for t in grid)
    near = [(restricted((best[1] + i, best[2] + j), fixed, covs, y)[0], best[1] + i, best[2] + j)
            for i in np.linspace(-1, 1, 21) for j in np.linspace(-1, 1, 21)]
    _, s, t = min(near)
    _, p, v = restricted((s, t), fixed, covs, y)
    want = y - p @ y
    got = model.transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 0.01
    assert abs(model.summary["edf"] - np.trace(np.eye(len(y)) - p)) < 0.1
    rss = ((y - got) ** 2).sum()
    assert abs(model.summary["deviance_explained"] - (1 - rss / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert model.edf[0] > 3 and model.edf[1] < 2


def test_gcv_terms_and_null(spark, data):
    df, pdf = data
    model = fit_additive(df, ["a", "b c"], "y", method="GCV")
    out = model.transform(df, terms=True).toPandas()
    assert abs(out["s_a"].mean()) < 1e-9 and abs(out["s_b c"].mean()) < 1e-9
    assert np.allclose(out["prediction"], model.intercept + out["s_a"] + out["s_b c"])
    assert [r["term"] for r in model.terms(spark).collect()] == ["a", "b c"]
    odd = frame(spark, pd.DataFrame({"a": [0.5, None, 99.0], "b c": [0.1, 0.1, 0.1]}))
    got = [r["prediction"] for r in model.transform(odd).collect()]
    end = frame(spark, pd.DataFrame({"a": [float(pdf["a"].max())], "b c": [0.1]}))
    assert got[0] is not None and got[1] is None and abs(got[2] - model.transform(end).first()["prediction"]) < 1e-9
    with pytest.raises(ValueError):
        fit_additive(df.withColumn("a", df["a"] * 0), ["a"], "y")
