"""Joint mean and variance: the likelihood never rises, its gradient vanishes, and the true model is found."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from limnos.plans.gaussian import LOG_2PI
from limnos.plans.models import load_gaussian, save_gaussian, train_gaussian
from limnos.plans.score import score_batch


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    n = 3000
    a, b = r.normal(size=n), r.normal(size=n)
    y = 2 + a - 0.5 * b + 0.3 * a * b + r.normal(size=n) * np.exp(0.5 * (-1 + 1.2 * a - 0.4 * b))
    pdf = pd.DataFrame({"k": range(n), "a": 10 + 2 * a, "b": b, "y": y})
    pdf.loc[3, "b"] = np.nan
    return pdf.dropna(), frame(spark, pdf)


def nll(pdf, out):
    mu, lv = (out.sort_values("k")[c].to_numpy() for c in ("mu", "logvar"))
    return np.mean(0.5 * (LOG_2PI + lv + (pdf.y.to_numpy() - mu) ** 2 / np.exp(lv)))


@pytest.mark.parametrize("kind", ["linear", "polynomial"])
def test_likelihood_falls_to_a_stationary_point(spark, data, kind):
    pdf, df = data
    gm = train_gaussian(df, ["a", "b"], "y", kind)
    trace = gm.mean.params["trace"]
    assert len(trace) > 3 and all(x >= y for x, y in zip(trace, trace[1:]))
    out = gm.transform(df.na.drop()).toPandas()
    assert np.isclose(nll(pdf, out), trace[-1], atol=1e-9)
    # brute force: moving any coefficient makes it worse
    z = pdf[["a", "b"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    x = np.column_stack([np.ones(len(z)), z] + ([z[:, 0] ** 2, z[:, 0] * z[:, 1], z[:, 1] ** 2] if kind == "polynomial" else []))
    v = np.column_stack([np.ones(len(z)), z])
    b, c, y = np.array(gm.mean.params["coefficients"]), np.array(gm.mean.params["variance"]), pdf.y.to_numpy()

    def value(b, c):
        return np.mean(0.5 * (LOG_2PI + v @ c + (y - x @ b) ** 2 * np.exp(-(v @ c))))

    r = np.random.default_rng(0)
    for _ in range(300):
        assert value(b + 0.02 * r.normal(size=len(b)), c + 0.02 * r.normal(size=3)) > value(b, c)
    if kind == "polynomial":
        assert np.allclose(c, [-1, 1.2, -0.4], atol=0.15)
        assert abs(b[4] - 0.3) < 0.05


def test_roundtrip_and_scoring(spark, data, tmp_path):
    _, df = data
    gm = train_gaussian(df, ["a", "b"], "y", "polynomial")
    save_gaussian(gm, f"{tmp_path}/gm")
    a, b = (m.transform(df).select("k", "mu", "logvar").orderBy("k").collect() for m in (gm, load_gaussian(f"{tmp_path}/gm")))
    assert a == b
    rows = score_batch(gm, df.limit(20)).collect()
    assert all(r["DO_LowerCI"] <= r["DO_Predicted"] <= r["DO_UpperCI"] for r in rows if r["DO_Predicted"] is not None)
