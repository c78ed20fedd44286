"""Sums of products: fits, grids and penalised paths against numpy on the rows themselves."""

import json

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.plans import moments as M
from limnos.plans.models import train
from limnos.plans.tuning import basic_vs_enhanced, cross_val_scores, grid_search


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    n = 400
    x = r.normal([100, -3, 5], [10, 0.1, 2], (n, 3))
    y = 0.3 * x[:, 0] - 4 * x[:, 1] + 0.02 * (x[:, 0] - 100) * x[:, 2] + r.normal(size=n)
    pdf = pd.DataFrame({"k": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": np.arange(n) % 4})
    pdf.loc[5, "a"] = np.nan
    return pdf.dropna(), frame(spark, pdf)


def terms_of(z):
    p = z.shape[1]
    return np.column_stack([*z.T, *(z[:, i] * z[:, j] for i in range(p) for j in range(i, p))])


def test_fold_fits_equal_fits_on_the_rows(data):
    pdf, df = data
    m = M.group_moments(df, ["a", "b", "c"], "y", "fold")
    x, y, fold = pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy(), pdf.fold.to_numpy()
    points = [{"degree": d, "k_best": k, "alpha": a} for d in (1, 2) for k in (None, 2, 5) for a in (0.01, 10.0)]
    for f in range(4):
        fit, held = fold != f, fold == f
        mean, sd = x[fit].mean(0), x[fit].std(0)
        t = terms_of((x - mean) / sd)
        got = M.fit_points(m, [g for g in range(4) if g != f], [f], "ridge", points)
        for p, (n, mse, r2) in zip(points, got, strict=True):
            z = t[:, :3] if p["degree"] == 1 else t
            score = np.abs([np.corrcoef(c, y[fit])[0, 1] for c in z[fit].T])
            if p["k_best"]:
                z = z[:, sorted(np.argsort(-score, kind="stable")[:p["k_best"]])]
            zc = z[fit] - z[fit].mean(0)
            w = np.linalg.solve(zc.T @ zc + p["alpha"] * np.eye(z.shape[1]), zc.T @ (y[fit] - y[fit].mean()))
            e = y[held] - y[fit].mean() - (z[held] - z[fit].mean(0)) @ w
            assert n == held.sum() and np.isclose(mse, (e ** 2).mean(), rtol=1e-8)
            assert np.isclose(r2, 1 - (e ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum(), rtol=1e-7)


def test_grid_equals_refits(data):
    _, df = data
    grid = {"degree": [1, 2], "k_best": [2, None], "alpha": [0.1, 5.0]}
    got = {r.params: (r.mean_mse, r.mean_r2) for r in grid_search(df, ["a", "b", "c"], "y", "k", "ridge", grid, 3).collect()}
    assert len(got) == 8
    for params, want in got.items():
        folds = cross_val_scores(df, ["a", "b", "c"], "y", "k", "ridge", 3, **json.loads(params)).toPandas()
        assert np.allclose(want, (folds.mse.mean(), folds.r2.mean()), atol=2e-6)
    row = basic_vs_enhanced(df, ["a"], ["a", "b", "c"], "y", "k", enhanced_kind="ridge", grid=grid).first()
    assert row.enhanced_r2 > row.basic_r2 > 0 and abs(row.r2_gain - (row.enhanced_r2 - row.basic_r2)) < 1e-9


def objective(z, y, w, alpha, ratio):
    e = y - y.mean() - z @ w
    return (e ** 2).mean() / 2 + alpha * (ratio * np.abs(w).sum() + (1 - ratio) / 2 * (w ** 2).sum())


def test_penalised_path_is_the_minimum(data):
    pdf, df = data
    x, y = pdf[["a", "b"]].to_numpy(), pdf.y.to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    r = np.random.default_rng(1)
    for kind, ratios in (("lasso", [1.0]), ("elastic_net", [0.2, 0.8])):
        rows = M.penalised_path(df, ["a", "b"], "y", kind, [0.01, 0.3, 2.0, 50.0], ratios).toPandas()
        for (ratio, alpha), part in rows.groupby(["l1_ratio", "alpha"]):
            w = part.set_index("term").coefficient[["a", "b"]].to_numpy()
            best = objective(z, y, w, alpha, ratio)
            for step in (1e-3, 1e-2, 0.3):        # brute force: nothing near is better, nor zero
                for d in r.normal(size=(200, 2)):
                    assert best <= objective(z, y, w + step * d, alpha, ratio) + 1e-12
            assert np.isclose(part.intercept.iloc[0], y.mean())
            if alpha == 50.0 and ratio > 0.5:
                assert not w.any()
            tm = train(df.select("a", "b", "y"), ["a", "b"], "y", kind, alpha=alpha, l1_ratio=ratio)
            assert np.allclose(tm.regressor.coefficients.toArray(), w, atol=2e-3)


def test_only_keeps_the_terms_of_its_features(data):
    _, df = data
    m = M.group_moments(df, ["a", "b", "c"], "y", "fold")
    part, alone = m.only(["c", "a"]), M.group_moments(df.where("a IS NOT NULL"), ["c", "a"], "y", "fold")
    assert part.names() == alone.names()
    for g in range(4):
        assert np.allclose(part.sums[g], alone.sums[g], rtol=1e-6, atol=1e-6)
    assert M.group_moments(df.limit(0), ["a"], "y").sums == {}
