"""Pairwise-complete Pearson correlation (D10) and correlated-feature
selection (D11).

All k(k-1)/2 ``corr`` / ``regr_count`` pairs are one aggregate (one pass,
partial aggregation, O(k^2) state per task).  SQL ``corr`` skips a row
when either side is null, i.e. pandas' pairwise-complete ``.corr()``.
``ml.stat.Correlation`` is not used: it needs complete vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.tdist import pearson_p_value
from limnos.operators.profile import q


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def corr_matrix(df: DataFrame, cols: Sequence[str], symmetric: bool = False, digits: int | None = 6) -> DataFrame:
    """Long table (col_a, col_b, n, r) for every pair a < b (by position).

    ``symmetric=True`` also emits (b, a) and the diagonal (r = 1), i.e. the
    full matrix in long form.  ``n`` is the number of complete pairs.
    """
    cols = list(cols)
    pairs = _pairs(cols)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        A, Bc = F.col(q(a)).cast("double"), F.col(q(b)).cast("double")
        aggs += [F.regr_count(Bc, A).alias(f"n{i}"), F.corr(A, Bc).alias(f"r{i}")]
    if symmetric:
        aggs += [F.count(F.col(q(c))).alias(f"d{j}") for j, c in enumerate(cols)]
    if not aggs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n bigint, r double")
    wide = df.agg(*aggs)
    parts = []
    for i, (a, b) in enumerate(pairs):
        r = F.round(F.col(f"r{i}"), digits) if digits is not None else F.col(f"r{i}")
        parts.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"n{i}").alias("n"), r.alias("r")))
        if symmetric:
            parts.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"n{i}").alias("n"), r.alias("r")))
    if symmetric:
        for j, c in enumerate(cols):
            parts.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.col(f"d{j}").alias("n"),
                                  F.lit(1.0).alias("r")))
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def correlation_stats(df: DataFrame, targets: Sequence[str], features: Sequence[str]) -> list[dict]:
    """(target, feature, n, r, p_value) for every target x feature pair (one aggregate)."""
    pairs = [(t, f) for t in targets for f in features if f != t]
    aggs = []
    for i, (t, f) in enumerate(pairs):
        Tc, Fc = F.col(q(t)).cast("double"), F.col(q(f)).cast("double")
        aggs += [F.regr_count(Tc, Fc).alias(f"n{i}"), F.corr(Tc, Fc).alias(f"r{i}")]
    if not aggs:
        return []
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, (t, f) in enumerate(pairs):
        n, r = int(row[f"n{i}"]), row[f"r{i}"]
        r = None if r is None or (isinstance(r, float) and math.isnan(r)) else float(r)
        out.append({"target": t, "feature": f, "n": n, "r": r,
                    "p_value": pearson_p_value(r, n) if r is not None else None})
    return out


CORRELATED_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("r", T.DoubleType()),
    T.StructField("abs_r", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
])


def correlated_features(df: DataFrame, targets: Sequence[str], features: Sequence[str] | None = None,
                        threshold: float = 0.3, p_max: float = 0.05, min_pairs: int = 10,
                        digits: int | None = 6) -> DataFrame:
    """Per target, features with |r| > threshold, p < p_max and more than
    ``min_pairs`` complete pairs, ranked by |r| descending.

    The correlations are one Spark aggregate; the p-values (Student t,
    n - 2 df) are computed on the driver from that k x k table.  A feature
    that is all-null has no pairs and is skipped.  Returns a small frame.
    """
    if features is None:
        features = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = correlation_stats(df, targets, features)
    rows = []
    for t in targets:
        kept = [s for s in stats if s["target"] == t and s["r"] is not None and s["n"] > min_pairs
                and abs(s["r"]) > threshold and s["p_value"] is not None and s["p_value"] < p_max]
        kept.sort(key=lambda s: (-abs(s["r"]), s["feature"]))
        for rank, s in enumerate(kept, start=1):
            r = round(s["r"], digits) if digits is not None else s["r"]
            rows.append((t, s["feature"], s["n"], r, abs(r), float(s["p_value"]), rank))
    return df.sparkSession.createDataFrame(rows, CORRELATED_SCHEMA)
