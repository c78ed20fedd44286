from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.operators.ranking import argbest_many, rank_within_groups, topk_per_group
from limnos.operators.reshape import pivot_aligned, pivot_wide, unpivot_long


def test_rank_within_groups_equals_row_number(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    got = rank_within_groups(df, "g", "k", partitions=3).select("k", "rn")
    exp = df.select("k", F.row_number().over(Window.partitionBy("g").orderBy("k")).alias("rn"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_topk_per_group_matches_naive(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"),
                                  (F.col("id") * 7919 % 101).cast("double").alias("v"))
    got = topk_per_group(df, "g", "v", 5, tiebreak=["k"], salts=7).select("g", "k", "rank")
    w = Window.partitionBy("g").orderBy(F.desc("v"), "k")
    exp = df.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("g", "k", "rank")
    assert got.exceptAll(exp).count() == 0 and got.count() == 20


def test_pivot_unpivot_roundtrip_and_aligned(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "id int, a double, b double")
    long = unpivot_long(wide, ["id"], ["a", "b"])
    back = pivot_wide(long, ["id"], "variable", "value", ["a", "b"], agg="first")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    ev = spark.createDataFrame([(1, "x", 1.0), (2, "y", 5.0), (3, "x", 2.0), (4, "x", 3.0)], "rid int, k string, v double")
    al = {r["row_id"]: (r["x"], r["y"]) for r in pivot_aligned(ev, "k", "v", "rid", ["x", "y"]).collect()}
    assert al == {1: (1.0, 5.0), 2: (2.0, None), 3: (3.0, None)}


def test_argbest_many(spark):
    board = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.5, 0.9)], "model string, rmse double, r2 double")
    r = argbest_many(board, "model", [("rmse", "min", "m1", "v1"), ("r2", "max", "m2", "v2")]).collect()[0]
    assert (r["m1"], r["m2"]) == ("b", "b")


def test_rank_within_groups_keeps_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a")], "k long, g string")
    got = {r["k"]: r["rn"] for r in rank_within_groups(df, "g", "k").collect()}
    assert got == {1: 1, 3: 2, 2: 1, 4: 2}


def test_rank_by_value_hot_value_and_descending(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"k": np.arange(n), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[:999, "v"] = 0.0  # a third of the rows tie
    from limnos.operators.ranking import rank_by_value
    got = rank_by_value(spark.createDataFrame(pdf), ["v", "k"], partitions=7).toPandas().sort_values("rank")
    exp = pdf.sort_values(["v", "k"]).reset_index(drop=True)
    assert list(got["rank"]) == list(range(1, n + 1)) and list(got.k) == list(exp.k)
    desc = rank_by_value(spark.createDataFrame(pdf), ["v", "k"], descending=True).toPandas().sort_values("rank")
    assert list(desc.k) == list(pdf.sort_values(["v", "k"], ascending=False).k)
