import pytest

from limnos.operators.outliers import clip_percentile, iqr_filter, iqr_outlier_report, with_scalar_stats, zscore_filter
from limnos.plans.clean import clean_measurements


def _rows(spark):
    # temp, DO, chl ; one null target, one null temp, a DO outlier, a chl outlier
    data = [(10.0, 9.0, 0.01), (11.0, 9.5, 0.012), (12.0, 9.2, 0.011), (13.0, 9.8, 0.013),
            (14.0, 9.1, 0.014), (15.0, 0.1, 0.012), (16.0, 9.4, 0.9), (None, 9.3, 0.012),
            (12.5, None, 0.01), (11.5, 9.6, None)]
    return spark.createDataFrame(data, "temp double, do double, chl double")


def test_sequential_fences_keep_nulls_without_outliers(spark):
    report = []
    out = clean_measurements(_rows(spark), "do", ["temp", "do", "chl"], k=1.5, report=report)
    rows = out.collect()
    # null target dropped; temp has no outlier -> null temp kept; DO outlier removed; chl outlier removed (and chl null)
    assert [r["removed"] for r in report] == [0, 1, 1]
    assert any(r["temp"] is None for r in rows)
    assert all(r["do"] is not None and r["do"] > 1 for r in rows)
    assert all(r["chl"] is not None and r["chl"] < 0.5 for r in rows)


def test_drop_nulls_flag(spark):
    out = iqr_filter(_rows(spark).na.drop(subset=["do"]), ["temp"], k=3.0, drop_nulls=True)
    assert out.where("temp is null").count() == 0


def test_fence_is_inclusive(spark):
    # Q1 = 2, Q3 = 4, IQR = 2, k = 1 -> fences 0 .. 6; values on a fence stay
    df = spark.createDataFrame([(float(v),) for v in [0, 2, 2, 2, 4, 4, 4, 6, 10]], "x double")
    rep = iqr_outlier_report(df, ["x"], k=1.0).collect()[0]
    assert (rep["lower"], rep["upper"], rep["n_outliers"]) == (0.0, 6.0, 1)
    kept = [r["x"] for r in iqr_filter(df, ["x"], k=1.0).collect()]
    assert 0.0 in kept and 6.0 in kept and 10.0 not in kept


def test_zscore_population_std_and_constant(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "y double")
    out = [r["y"] for r in zscore_filter(df, "y", 1.5).collect()]
    assert 100.0 not in out and None not in out and len(out) == 4
    const = spark.createDataFrame([(5.0,), (5.0,)], "y double")
    assert zscore_filter(const, "y", 1.0).count() == 2


def test_clip_percentile_and_scalar_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "v double")
    out = clip_percentile(df, "v", 1, 99, out="c").collect()
    vals = [r["c"] for r in out if r["c"] is not None]
    assert min(vals) == 1.0 and max(vals) == 99.0
    assert sum(r["c"] is None for r in out) == 1
    stats = df.selectExpr("avg(v) as m")
    assert with_scalar_stats(df, stats).select("m").distinct().count() == 1
    with pytest.raises(ValueError):
        with_scalar_stats(df, df.select("v"))
