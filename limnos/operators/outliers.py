"""Outlier report and filters.

Fences are one-row statistics: they are computed once (exact quantile
selection or one ``avg``/``stddev_pop`` pass) and applied as literals, so
the filter is a narrow ``where`` that Catalyst pushes into the Parquet
scan -- no self-join, no doubling of the plan per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.scalar import clip
from limnos.operators.profile import q
from limnos.operators.quantiles import quantiles


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True) -> dict[str, tuple]:
    """{col: (q1, q3, lower, upper)} with lower = Q1 - k IQR, upper = Q3 + k IQR."""
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_outlier_report(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True,
                       digits: int = 6) -> DataFrame:
    """Per column the count and % of rows outside the fences.

    Nulls are not outliers; the percentage is of all rows.  One quantile
    selection for all columns, then one counting pass for all columns.
    """
    cols = list(cols)
    fences = iqr_fences(df, cols, k, exact)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        _, _, lo, hi = fences[c]
        x = F.col(q(c))
        aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}"))
    wide = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi = fences[c]
        parts.append(F.struct(
            F.lit(c).alias("column"),
            F.round(F.lit(q1), digits).alias("q1"), F.round(F.lit(q3), digits).alias("q3"),
            F.round(F.lit(lo), digits).alias("lower"), F.round(F.lit(hi), digits).alias("upper"),
            F.col(f"o{i}").alias("n_outliers"),
            F.round(F.try_divide(F.col(f"o{i}") * 100.0, F.col("n")), digits).alias("pct_outliers")))
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def iqr_filter(df: DataFrame, cols: Sequence[str], k: float = 3.0, drop_nulls: bool = False,
               exact: bool = True, report: list | None = None) -> DataFrame:
    """Sequential inclusive IQR fences.

    Column j's fences are computed on the rows that survived columns
    1..j-1.  A column with no outlier changes nothing (its nulls stay,
    parity with the reference); a column with outliers keeps only
    ``lower <= x <= upper``, which also drops its nulls.  ``drop_nulls``
    drops a column's nulls in every case.

    Each step is: exact quantiles of the current frame, one count of
    outliers, then a literal range filter pushed to the scan.  The chain
    of literal filters is re-evaluated from the (pruned, pushed-down)
    source, so lineage stays short and no self-join is planned.
    """
    current = df
    for c in cols:
        q1, q3, lo, hi = iqr_fences(current, [c], k, exact)[c]
        x = F.col(q(c))
        n_out = current.agg(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias("o")).collect()[0]["o"]
        if report is not None:
            report.append({"column": c, "lower": lo, "upper": hi, "removed": int(n_out)})
        if n_out > 0 or drop_nulls:
            current = current.where(x.between(F.lit(lo), F.lit(hi)))
    return current


def zscore_filter(df: DataFrame, target: str, threshold: float = 3.0) -> DataFrame:
    """Keep rows with |z| <= threshold on the target (population std).

    Null targets are dropped; if the std is 0 or undefined the filter is a
    no-op apart from that.  Mean and std are one pass; they are applied as
    literals, so the predicate is pushed into the scan.
    """
    x = F.col(q(target))
    row = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd")).collect()[0]
    kept = df.where(x.isNotNull())
    mu, sd = row["mu"], row["sd"]
    if sd is None or sd == 0 or sd != sd:
        return kept
    # a slightly widened range prefilter is implied by the z test and can be
    # pushed into the Parquet scan (row-group skipping); the z test decides
    slack = 1e-9 * (abs(mu) + threshold * sd)
    lo, hi = mu - threshold * sd - slack, mu + threshold * sd + slack
    return kept.where(x.between(F.lit(lo), F.lit(hi)) & (F.abs((x - F.lit(mu)) / F.lit(sd)) <= F.lit(threshold)))


def clip_percentile(df: DataFrame, col: str, lower_pct: float = 1.0, upper_pct: float = 99.0,
                    reference: DataFrame | None = None, ref_col: str | None = None,
                    out: str | None = None, exact: bool = True) -> DataFrame:
    """Bound ``col`` by percentiles of an observed column (default itself)."""
    ref = reference if reference is not None else df
    ref_col = ref_col or col
    lo, hi = quantiles(ref, [ref_col], [lower_pct / 100.0, upper_pct / 100.0], exact=exact)[ref_col]
    return df.withColumn(out or col, clip(F.col(q(col)), F.lit(lo), F.lit(hi)))


def with_scalar_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach whole-table statistics to every row.

    ``stats`` must be exactly one row (checked with ``limit(2)``); its
    values are collected and added as literal columns -- no join at all.
    """
    rows = stats.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"scalar statistics must be exactly one row, got {len(rows)}")
    fields = stats.schema.fields
    return df.withColumns({f.name: F.lit(rows[0][f.name]).cast(f.dataType) for f in fields})
