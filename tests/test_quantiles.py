from conftest import frame
import numpy as np
import pandas as pd

from limnos.operators.quantiles import approx_quantiles, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_exact_matches_numpy_with_hot_value_and_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=20000)
    x[:7000] = 2.5  # a third of the rows share one value
    y = np.round(rng.normal(size=20000), 1)
    pdf = pd.DataFrame({"x": x, "y": y})
    pdf.loc[10:200, "y"] = None
    df = frame(spark, pdf).repartition(7)
    got = exact_quantiles(df, ["x", "y"], PROBS, accuracy=100, small_bracket=50)
    for c in ["x", "y"]:
        exp = np.nanquantile(pdf[c].to_numpy(dtype=float), PROBS)
        assert np.allclose(got[c], exp, rtol=0, atol=1e-12)


def test_exact_small_and_degenerate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,)], "a double")
    assert exact_quantiles(df, ["a"], [0.25, 0.5, 0.75])["a"] == [1.5, 2.0, 6.0]
    one = spark.createDataFrame([(4.0,)], "a double")
    assert exact_quantiles(one, ["a"], [0.1, 0.9])["a"] == [4.0, 4.0]
    empty = spark.createDataFrame([(None,)], "a double")
    assert all(v != v for v in exact_quantiles(empty, ["a"], [0.5])["a"])


def test_approx_is_close(spark):
    df = spark.range(10000).selectExpr("cast(id as double) as v")
    got = approx_quantiles(df, ["v"], [0.5])["v"][0]
    assert abs(got - 4999.5) <= 2


def test_grouped_kth_smallest_exact(spark):
    from limnos.operators.quantiles import grouped_kth_smallest
    rng = np.random.default_rng(8)
    n, groups = 6000, 5
    pdf = pd.DataFrame({"g": rng.integers(0, groups, n), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[:2000, "v"] = 0.5  # hot value
    df = frame(spark, pdf)
    for k in (1, 50, 600):
        got = grouped_kth_smallest(df, "g", "v", k, groups, small_bracket=20, accuracy=100, sketch_points=10)
        exp = [np.sort(pdf[pdf.g == i].v.to_numpy())[k - 1] for i in range(groups)]
        assert np.allclose(got, exp)
