from conftest import frame
import math

import pandas as pd

from limnos.operators.profile import (combined_range, describe, glimpse, histogram, level_counts, missing_counts,
                                      profile_text)


def test_missing_and_describe(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0], "b": [None, None, None, 1.0]})
    df = frame(spark, pdf)
    m = {r["column"]: r["n_missing"] for r in missing_counts(df).collect()}
    assert m == {"a": 1, "b": 3}
    d = {r["column"]: r for r in describe(df, ["a"]).collect()}["a"]
    assert d["count"] == 3 and math.isclose(d["std"], pd.Series([1.0, 2.0, 4.0]).std(), rel_tol=1e-6)
    assert d["p50"] == 2.0 and d["p25"] == 1.5


def test_profile_text_counts(spark):
    df = spark.createDataFrame([("ab",), ("",), ("  ",), (None,), ("ab",)], "t string")
    r = profile_text(df, ["t"]).collect()[0]
    assert (r["n_missing"], r["n_empty"], r["n_whitespace"], r["n_unique"]) == (1, 1, 1, 3)
    assert (r["min_length"], r["max_length"]) == (0, 2)


def test_histogram_max_in_last_bin_and_empty_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 9, 10]], "x double")
    h = {r["bin"]: r["n"] for r in histogram(df, "x", bins=5).collect()}
    assert h == {0: 3, 1: 0, 2: 0, 3: 0, 4: 2}
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(r["n"] for r in histogram(const, "x", 4).collect()) == 2


def test_level_counts_glimpse_range(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (2, "b", None, 7.0), (3, "a", 9.0, 2.0)], "k int, c string, x double, y double")
    assert [tuple(r) for r in level_counts(df, "c").collect()] == [("a", 2), ("b", 1)]
    g = {r["column"]: r["first_values"] for r in glimpse(df, "k", 2).collect()}
    assert g["c"] == "a, b"
    r = combined_range(df, "x", "y").collect()[0]
    assert (r["range_min"], r["range_max"]) == (1.0, 9.0)
