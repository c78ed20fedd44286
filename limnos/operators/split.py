"""Deterministic splits, folds and holdout masks.

Everything is a pure function of a row key: ``md5(key)`` -> bucket.  The
result does not depend on partitioning, task order or executor loss (a
recomputed task gives the same rows), and it is reproducible in SQL.
``randomSplit`` is not used: its output depends on partition layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.scalar import hash_bucket
from limnos.operators.profile import q


def hash_split(df: DataFrame, keys: Sequence[str] | str, cuts: Sequence[int] = (80,),
               labels: Sequence[str] = ("train", "test"), col: str = "split",
               salt: str | None = None) -> DataFrame:
    """L1/L2: label rows by bucket = md5(key) % 100 against cut points.

    ``cuts=(80,)`` -> train/test 80/20; ``cuts=(70, 85)`` with labels
    train/val/test -> 70/15/15.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cut points")
    b = hash_bucket(keys, 100, salt)
    expr = F.lit(labels[-1])
    for cut, lab in reversed(list(zip(cuts, labels[:-1]))):
        expr = F.when(b < F.lit(cut), F.lit(lab)).otherwise(expr)
    return df.withColumn(col, expr)


def hash_folds(df: DataFrame, keys: Sequence[str] | str, k: int = 5, col: str = "fold",
               salt: str | None = None) -> DataFrame:
    """L3: fold id in [0, k) from md5(key) % k (used as ``foldCol`` in CrossValidator)."""
    return df.withColumn(col, hash_bucket(keys, k, salt).cast("int"))


def mask_holdout(df: DataFrame, col: str, keys: Sequence[str] | str, frac: float = 0.1,
                 truth_col: str | None = None, flag_col: str | None = None,
                 min_masked: int | None = None, min_observed: int | None = None) -> DataFrame:
    """Hide ``frac`` of the *observed* values of ``col``, keep the truth.

    bucket = md5(key ':' col) % 1000 < frac * 1000 -> NULL.  The column name
    salts the hash so different columns get independent masks.  Adds
    ``<col>_truth`` (original value) and ``<col>_masked`` (boolean).  With
    ``min_masked`` / ``min_observed`` the counts are checked (one agg) and
    a ValueError is raised when the holdout would be too small.
    """
    truth_col = truth_col or f"{col}_truth"
    flag_col = flag_col or f"{col}_masked"
    x = F.col(q(col))
    hide = x.isNotNull() & (hash_bucket(keys, 1000, col) < F.lit(int(round(frac * 1000))))
    out = df.withColumns({truth_col: x, flag_col: hide}).withColumn(col, F.when(F.col(flag_col), F.lit(None)).otherwise(x))
    if min_masked is not None or min_observed is not None:
        row = out.agg(F.count_if(F.col(flag_col)).alias("m"), F.count(F.col(q(col))).alias("o")).collect()[0]
        if min_masked is not None and row["m"] < min_masked:
            raise ValueError(f"only {row['m']} values masked in {col}; need {min_masked}")
        if min_observed is not None and row["o"] < min_observed:
            raise ValueError(f"only {row['o']} observed values left in {col}; need {min_observed}")
    return out


def mask_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] | str, frac: float = 0.1) -> DataFrame:
    """Hide ``frac`` of each column independently (no truth columns)."""
    repl = {}
    for c in cols:
        x = F.col(q(c))
        repl[c] = F.when(hash_bucket(keys, 1000, c) < F.lit(int(round(frac * 1000))), F.lit(None)).otherwise(x)
    return df.withColumns(repl)


def split_counts(df: DataFrame, col: str = "split") -> DataFrame:
    """Row count per split / fold label."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def contiguous_folds(df: DataFrame, order_col: str, k: int = 5, col: str = "fold") -> DataFrame:
    """unshuffled K-fold over the row order (scikit-learn ``KFold``): the
    first n mod k folds hold one extra row.

    Row numbers come from the range-partitioned ``rank_by_value`` (no global
    window); ``order_col`` must be a unique row id.
    """
    from limnos.operators.ranking import rank_by_value
    n = df.count()
    base, extra = divmod(n, k)
    big = extra * (base + 1)  # rows in the larger folds
    ranked = rank_by_value(df, [order_col], out="_rn")
    i = F.col("_rn") - 1
    fold = F.when(i < F.lit(big), F.floor(i / F.lit(base + 1))).otherwise(
        F.lit(extra) + F.floor((i - F.lit(big)) / F.lit(max(base, 1))))
    return ranked.withColumn(col, fold.cast("int")).drop("_rn")
