"""Profiling: shape, missing counts, describe, skim-style profiles,
level counts, glimpse, histogram and combined range (D1-D6, D9, D13, D21).

Every statistic over many columns is one fused ``agg`` (one pass, map-side
partial aggregation, one row per task shuffled); percentiles come from the
exact selection in ``quantiles`` and enter as literals.  Long output is an
``explode`` of an array of per-column structs over that one-row frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.quantiles import quantiles, quantiles_with_stats


def q(name: str) -> str:
    """Back-tick a column name (names may hold spaces, slashes, hyphens)."""
    return "`" + name.replace("`", "``") + "`"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _stack_long(wide: DataFrame, cols: Sequence[str], fields: Sequence[str], key: str = "column") -> DataFrame:
    """One-row frame with ``{i}_{field}`` columns -> one row per column."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(F.struct(F.lit(c).alias(key), *[F.col(f"c{i}_{f}").alias(f) for f in fields]))
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column -> (column, n_missing, n_rows, pct_missing)."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(q(c)).isNull()).alias(f"c{i}_n_missing"))
    wide = df.agg(*aggs)
    for i in range(len(cols)):
        wide = wide.withColumn(f"c{i}_n_rows", F.col("n"))
    out = _stack_long(wide, cols, ["n_missing", "n_rows"])
    return out.withColumn("pct_missing", F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 6))


def _literal_row(spark, values: dict, types: dict) -> DataFrame:
    """One-row frame of literal statistics (typed), so rounding stays in Spark."""
    return spark.range(1).select(*[F.lit(v).cast(types[k]).alias(k) for k, v in values.items()])


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
             digits: int | None = 6) -> DataFrame:
    """D3: count, mean, sample std, min, 25/50/75 % (linear), max per column.

    Not ``df.summary()`` (approximate percentiles).  Percentiles come from
    exact selection (``exact=True``) or a sketch pass; the moments ride in
    the selection's first pass (no separate scan).
    """
    cols = list(cols or numeric_columns(df))
    stats = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        stats += [F.count(x).alias(f"c{i}_count"), F.avg(x).alias(f"c{i}_mean"),
                  F.stddev_samp(x).alias(f"c{i}_std"), F.min(x).alias(f"c{i}_min"),
                  F.max(x).alias(f"c{i}_max")]
    qs, row = quantiles_with_stats(df.select(*[F.col(q(c)) for c in cols]), cols, [0.25, 0.5, 0.75], stats,
                                   exact=exact)
    values, types = {}, {}
    for i, c in enumerate(cols):
        for f in ("count", "mean", "std", "min", "max"):
            values[f"c{i}_{f}"] = row[f"c{i}_{f}"]
            types[f"c{i}_{f}"] = "bigint" if f == "count" else "double"
        for name, v in zip(("p25", "p50", "p75"), qs[c]):
            values[f"c{i}_{name}"] = v if v == v else None
            types[f"c{i}_{name}"] = "double"
    wide = _literal_row(df.sparkSession, values, types)
    fields = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    out = _stack_long(wide, cols, fields)
    if digits is not None:
        out = out.select("column", "count", *[F.round(f, digits).alias(f) for f in fields[1:]])
    return out


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                    digits: int | None = 6, hist_bins: int = 5) -> DataFrame:
    """D5 (numeric): n_missing, complete_rate, mean, sd, p0, p25, p50, p75, p100
    and ``hist``: counts in ``hist_bins`` equal-width bins over [p0, p100]
    (the maximum in the last bin) as space-separated text.  Moments ride in
    the quantile selection's first pass; the bin counts need the range, so
    they take one more aggregate."""
    cols = list(cols or numeric_columns(df))
    proj = df.select(*[F.col(q(c)) for c in cols])
    stats = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        stats += [F.count_if(x.isNull()).alias(f"c{i}_n_missing"), F.avg(x).alias(f"c{i}_mean"),
                  F.stddev_samp(x).alias(f"c{i}_sd")]
    qs, row = quantiles_with_stats(proj, cols, [0.0, 0.25, 0.5, 0.75, 1.0], stats, exact=exact)
    hist_aggs = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        lo, hi = qs[c][0], qs[c][-1]
        if lo == lo and hi == hi:
            width = (hi - lo) if hi > lo else 1.0
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(hist_bins)), F.lit(hist_bins - 1))
            hist_aggs.append(F.concat_ws(" ", *[F.count_if(b == j).cast("string") for j in range(hist_bins)])
                             .alias(f"c{i}_hist"))
        else:
            hist_aggs.append(F.lit("").alias(f"c{i}_hist"))
    hrow = proj.agg(*hist_aggs).collect()[0]
    n = row["n"]
    values, types = {}, {}
    for i, c in enumerate(cols):
        nm = row[f"c{i}_n_missing"]
        values.update({f"c{i}_n_missing": nm, f"c{i}_mean": row[f"c{i}_mean"], f"c{i}_sd": row[f"c{i}_sd"],
                       f"c{i}_hist": hrow[f"c{i}_hist"]})
        types.update({f"c{i}_n_missing": "bigint", f"c{i}_mean": "double", f"c{i}_sd": "double",
                      f"c{i}_hist": "string"})
        for name, v in zip(("p0", "p25", "p50", "p75", "p100"), qs[c]):
            values[f"c{i}_{name}"] = v if v == v else None
            types[f"c{i}_{name}"] = "double"
    wide = _literal_row(df.sparkSession, values, types).withColumn("n", F.lit(n).cast("bigint"))
    for i in range(len(cols)):
        wide = wide.withColumn(f"c{i}_complete_rate",
                               F.try_divide(F.col("n") - F.col(f"c{i}_n_missing"), F.col("n")))
    fields = ["n_missing", "complete_rate", "mean", "sd", "p0", "p25", "p50", "p75", "p100", "hist"]
    out = _stack_long(wide, cols, fields)
    if digits is not None:
        out = out.select("column", "n_missing", *[F.round(f, digits).alias(f) for f in fields[1:-1]], "hist")
    return out


def profile_text(df: DataFrame, cols: Sequence[str] | None = None, approx_unique: bool = False) -> DataFrame:
    """D5 (text): n_missing, complete_rate, min/max length, n_empty, n_unique, n_whitespace.

    ``n_unique`` is an exact distinct count (Spark plans it as a distributed
    two-level aggregate); ``approx_unique=True`` uses HyperLogLog++.
    """
    cols = list(cols or string_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(q(c))
        aggs += [F.count_if(x.isNull()).alias(f"c{i}_n_missing"),
                 F.min(F.length(x)).cast("bigint").alias(f"c{i}_min_length"),
                 F.max(F.length(x)).cast("bigint").alias(f"c{i}_max_length"),
                 F.count_if(x == F.lit("")).alias(f"c{i}_n_empty"),
                 (F.approx_count_distinct(x) if approx_unique else F.count_distinct(x)).cast("bigint")
                 .alias(f"c{i}_n_unique"),
                 F.count_if(x.rlike(r"^\s+$")).alias(f"c{i}_n_whitespace")]
    wide = df.agg(*aggs)
    for i in range(len(cols)):
        wide = wide.withColumn(f"c{i}_complete_rate",
                               F.round(F.try_divide(F.col("n") - F.col(f"c{i}_n_missing"), F.col("n")), 6))
    fields = ["n_missing", "complete_rate", "min_length", "max_length", "n_empty", "n_unique", "n_whitespace"]
    return _stack_long(wide, cols, fields)


def level_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table of a category, most frequent first (ties by level)."""
    return (df.groupBy(F.col(q(col)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("level")))


def glimpse(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """(column, type, first_values) from the first ``n`` rows by ``order_by``.

    ``orderBy().limit(n)`` plans as a TakeOrdered: each task keeps its top
    ``n``, so nothing unbounded reaches one task.
    """
    head = df.orderBy(order_by).limit(n)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"),
                      F.concat_ws(", ", F.collect_list(F.col(q(c)).cast("string"))).alias("first_values"))
             for c, t in df.dtypes]
    return head.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def min_max(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    row = df.agg(F.min(F.col(q(col))).alias("lo"), F.max(F.col(q(col))).alias("hi")).collect()[0]
    return row["lo"], row["hi"]


def histogram(df: DataFrame, col: str, bins: int = 30, include_empty: bool = True) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; the max goes to the last bin.

    -> (bin, lower, upper, n).  The range is one agg; binning is a narrow
    projection and the count a partial aggregate over ``bins`` keys.
    """
    lo, hi = min_max(df, col)
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, lower double, upper double, n bigint")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    x = F.col(q(col))
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if include_empty:
        grid = spark.range(bins).withColumnRenamed("id", "bin")
        counts = grid.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])
    width = (hi - lo) / bins
    return counts.select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                         F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"),
                         F.col("n").cast("bigint").alias("n"))


def combined_range(df: DataFrame, a: str, b: str) -> DataFrame:
    """Min and max over two columns together (null-skipping)."""
    return df.agg(F.min(F.least(F.col(q(a)), F.col(q(b)))).alias("range_min"),
                  F.max(F.greatest(F.col(q(a)), F.col(q(b)))).alias("range_max"))


def imputation_summary(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing before/after with percentages, joined on column name."""
    b = missing_counts(before, cols).select("column", F.col("n_missing").alias("missing_before"),
                                            F.col("pct_missing").alias("pct_before"))
    a = missing_counts(after, cols).select("column", F.col("n_missing").alias("missing_after"),
                                           F.col("pct_missing").alias("pct_after"))
    return b.join(a, "column")
