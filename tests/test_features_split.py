import datetime as dt
import math

import numpy as np
import pandas as pd

from limnos.operators.features import (interaction_features, polynomial_features, polynomial_terms, ratio_features,
                                       scaled_with_missing, standardize, temporal_features)
from limnos.operators.split import hash_folds, hash_split, mask_holdout


def test_temporal_monday_zero_and_cycles(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6, 0), "2024-03-04 12:00:00", "x")],
                               "ts timestamp_ntz, s string, bad string")
    r = temporal_features(df).collect()[0].asDict()
    assert r["ts_dayofweek"] == 0 and r["ts_hour"] == 6 and r["ts_month"] == 1
    assert math.isclose(r["ts_hour_sin"], 1.0) and abs(r["ts_hour_cos"]) < 1e-12
    assert r["s_dayofweek"] == 0 and r["s_hour"] == 12  # string column fully parses -> used
    assert "bad" in r and "ts" not in r and "s" not in r


def test_ratio_and_interaction_zero_divisor(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0.0), (20.0, 5.0, 0.5)], "temp double, do double, chl double")
    r = ratio_features(df, "temp", "do", "chl").collect()
    assert r[0]["temp_doxy_ratio"] is None and r[1]["temp_doxy_ratio"] == 4.0
    assert r[0]["log_chl_a"] == 0.0
    i = interaction_features(df, "chl", "temp", "do").collect()
    assert math.isclose(i[0]["do_temp_ratio"], 0.0) and math.isclose(i[0]["chla_log"], math.log(1e-5))
    assert len([c for c in i[0].asDict() if c not in ("temp", "do", "chl")]) == 11


def test_polynomial_order(spark):
    assert polynomial_terms(["a", "b"], 2, include_bias=True) == [(), ("a",), ("b",), ("a", "a"), ("a", "b"), ("b", "b")]
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    r = polynomial_features(df, ["a", "b"], 2).collect()[0]
    assert (r["a*a"], r["a*b"], r["b*b"]) == (4.0, 6.0, 9.0)


def test_standardize_population_std_fit_on_train(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (100.0, "test")], "x double, split string")
    out = standardize(df, ["x"], fit_df=df.where("split = 'train'"), suffix="_z").collect()
    assert [r["x_z"] for r in out][:2] == [-1.0, 1.0]
    m = scaled_with_missing(spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double"), ["x"]).collect()
    assert m[1]["x_z"] == 0.0 and m[1]["x_missing"] == 1.0
    assert math.isclose(m[0]["x_z"], -1 / math.sqrt(2 / 3))


def test_hash_split_independent_of_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = hash_split(df.repartition(1), "k", (70, 85), ("train", "val", "test")).orderBy("k").collect()
    b = hash_split(df.repartition(17), "k", (70, 85), ("train", "val", "test")).orderBy("k").collect()
    assert a == b
    share = sum(r["split"] == "train" for r in a) / len(a)
    assert 0.66 < share < 0.74
    folds = {r["fold"] for r in hash_folds(df, "k", 5).collect()}
    assert folds == {0, 1, 2, 3, 4}


def test_mask_holdout_keeps_truth(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(1000), "v": np.arange(1000) * 1.0}))
    m = mask_holdout(df, "v", "k", 0.1, min_masked=11, min_observed=20).collect()
    hidden = [r for r in m if r["v_masked"]]
    assert 60 < len(hidden) < 140
    assert all(r["v"] is None and r["v_truth"] is not None for r in hidden)
    assert all(r["v"] == r["v_truth"] for r in m if not r["v_masked"])
