from conftest import frame
import math

import numpy as np
import pandas as pd

from limnos.functions.tdist import pearson_p_value, t_two_sided_p
from limnos.operators.correlation import corr_matrix, correlated_features


def test_pairwise_complete_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"])
    pdf["b"] = pdf["a"] * 0.5 + pdf["b"]
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "c"] = None
    exp = pdf.corr()
    got = corr_matrix(frame(spark, pdf), ["a", "b", "c"], digits=None).collect()
    for r in got:
        assert math.isclose(r["r"], exp.loc[r["col_a"], r["col_b"]], rel_tol=1e-9)
    sym = corr_matrix(frame(spark, pdf), ["a", "b", "c"], symmetric=True).count()
    assert sym == 9


def test_p_values():
    assert math.isclose(t_two_sided_p(2.0, 10), 0.07338803477, rel_tol=1e-8)
    assert math.isclose(t_two_sided_p(1.959963985, 1e9), 0.05, rel_tol=1e-6)
    assert pearson_p_value(0.0, 50) == 1.0


def test_correlated_features_threshold_and_order(spark):
    rng = np.random.default_rng(2)
    n = 200
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"t": x, "strong": x + 0.1 * rng.normal(size=n), "weak": x + 3 * rng.normal(size=n),
                        "noise": rng.normal(size=n)})
    rows = correlated_features(frame(spark, pdf), ["t"]).collect()
    names = [r["feature"] for r in rows]
    assert names[0] == "strong" and "noise" not in names
    assert all(r["p_value"] < 0.05 and r["abs_r"] > 0.3 for r in rows)
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
