"""Ordering, row numbers, top-k, arg-best and leaderboards.

Skew safety: a group may hold a third of all rows, so no operator here
puts a whole group into one window partition.

* ``rank_within_groups`` subtracts a group's first number from the global
  number of ``rank_by_value``, a range-partitioned two-pass index over
  (group, key).  Equal to ``row_number() over (partition by g order by k)``.
* ``topk_per_group`` is a two-level reduction: top-k inside
  ``(group, salt)`` partitions, then top-k over the ``salts * k`` survivors
  of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.session import written


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


BROADCAST_GROUPS = 100_000      # rows per (group, partition) up to which the first numbers are broadcast


def rank_within_groups(df: DataFrame, groups: Sequence[str] | str, order_col: str, out: str = "rn",
                       partitions: int | None = None) -> DataFrame:
    """1-based row number within each group, ordered by a key.

    ``order_col`` must be unique within a group (a row id); ties would be
    numbered arbitrarily, exactly as ``row_number`` does.  Rows are numbered
    globally by (groups, key) with the range-partitioned index of
    ``rank_by_value``; a group's first number, one row per group from an
    aggregate, is then subtracted.  No window, so no group is sorted in one
    task.  The first numbers are broadcast up to ``BROADCAST_GROUPS`` of them, so rows are shuffled
    once; beyond, they are a written table, so the join can be split where a group is
    hot.  A NULL group is a group of its own.
    """
    g = _list(groups)
    placed = _ranged(df, [*g, order_col], False, partitions)
    named = [f"_g{i}" for i in range(len(g))]
    runs = placed.groupBy(*[F.col(q(c)).alias(n) for c, n in zip(g, named)], "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid"))        # a row per group and partition
    rows = runs.limit(BROADCAST_GROUPS + 1).collect()
    if len(rows) <= BROADCAST_GROUPS:
        sizes: dict = {}
        for r in rows:
            sizes[r["_pid"]] = sizes.get(r["_pid"], 0) + r["_n"]
        offsets = _offsets(sizes.items())
        first = F.broadcast(runs.groupBy(*named).agg(F.min_by(_position(offsets), F.col("_pid")).alias("_first")))
    else:
        runs = written(runs)
        offsets = _offsets(runs.groupBy("_pid").agg(F.sum("_n")).collect())
        first = written(runs.groupBy(*named).agg(F.min_by(_position(offsets), F.col("_pid")).alias("_first")))
    cond = F.lit(True)
    for c, n in zip(g, named):
        cond = cond & F.col(q(c)).eqNullSafe(F.col(n))
    return (placed.join(first, on=cond, how="inner")
            .withColumn(out, (_position(offsets) - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_first", *named))


def topk_per_group(df: DataFrame, groups: Sequence[str] | str, order_col: str, k: int,
                   descending: bool = True, tiebreak: Sequence[str] = (), out: str = "rank",
                   salts: int = 64) -> DataFrame:
    """The k best rows per group by ``order_col`` (ties broken by ``tiebreak`` asc).

    Level 1 keeps the top k inside ``(group, salt)`` with salt =
    xxhash64(tiebreak or all columns) mod ``salts``; level 2 ranks the at
    most ``salts * k`` survivors per group.  No group is sorted whole.
    """
    g = _list(groups)
    primary = F.col(q(order_col)).desc_nulls_last() if descending else F.col(q(order_col)).asc_nulls_last()
    order = [primary] + [F.col(q(t)).asc() for t in tiebreak]
    salt_src = [F.col(q(t)) for t in tiebreak] or [F.col(q(c)) for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salts)))
    lvl1 = (salted.withColumn("_r1", F.row_number().over(Window.partitionBy(*g, "_salt").orderBy(*order)))
            .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    return (lvl1.withColumn(out, F.row_number().over(Window.partitionBy(*g).orderBy(*order)))
            .where(F.col(out) <= k))


def top_k(df: DataFrame, order_col: str, k: int, descending: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """G2 (global): ``orderBy(...).limit(k)`` -- planned as TakeOrdered (k rows per task)."""
    primary = F.col(q(order_col)).desc_nulls_last() if descending else F.col(q(order_col)).asc_nulls_last()
    return df.orderBy(primary, *[F.col(q(t)).asc() for t in tiebreak]).limit(k)


def sort_by(df: DataFrame, cols: Sequence[str], descending: Sequence[bool] | bool = False,
            by_abs: bool = False) -> DataFrame:
    """G1: sort by keys; ``by_abs`` sorts by absolute value (e.g. |coefficient|)."""
    cols = _list(cols)
    desc = [descending] * len(cols) if isinstance(descending, bool) else list(descending)
    exprs = []
    for c, d in zip(cols, desc):
        e = F.abs(F.col(q(c))) if by_abs else F.col(q(c))
        exprs.append(e.desc() if d else e.asc())
    return df.orderBy(*exprs)


def argbest(df: DataFrame, name_col: str, metric: str, mode: str = "min", by: Sequence[str] | None = None) -> DataFrame:
    """The name with the min (or max) metric, with that metric value."""
    pick = F.min_by if mode == "min" else F.max_by
    best = F.min if mode == "min" else F.max
    aggs = [pick(F.col(q(name_col)), F.col(q(metric))).alias(f"best_{name_col}"),
            best(F.col(q(metric))).alias(f"best_{metric}")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def argbest_many(df: DataFrame, name_col: str, specs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """G3 for several metrics at once: specs of (metric, "min"|"max", name_alias, value_alias)."""
    aggs = []
    for metric, mode, name_alias, value_alias in specs:
        pick, best = (F.min_by, F.min) if mode == "min" else (F.max_by, F.max)
        aggs += [pick(F.col(q(name_col)), F.col(q(metric))).alias(name_alias), best(F.col(q(metric))).alias(value_alias)]
    return df.agg(*aggs)


def leaderboard(frames: Sequence[DataFrame]) -> DataFrame:
    """H1: stack per-model result rows (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rank_by_value(df: DataFrame, order: Sequence[str], out: str = "rank", descending: bool = False,
                  partitions: int | None = None) -> DataFrame:
    """global 1-based position after sorting by ``order`` (value columns
    then a key that makes the order total), e.g. the sample index of rows
    sorted by prediction.

    Range-partitioned two-pass index: ``repartitionByRange`` on the whole
    order (ties of a hot value are split by the key, so no partition holds a
    whole hot value), ``sortWithinPartitions``, a written table so both
    passes see the same partitions, one count per partition (P rows to the
    driver), then rank = partition offset + position inside the partition
    (``monotonically_increasing_id`` restarts its low bits per partition).
    No global window, no single-task sort.
    """
    ranged = _ranged(df, order, descending, partitions)
    offsets = _offsets(ranged.groupBy("_pid").count().collect())
    return ranged.withColumn(out, (_position(offsets) + 1).cast("bigint")).drop("_pid", "_mid")


def _ranged(df: DataFrame, order: Sequence[str], descending: bool, partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_pid`` and ``_mid``: partition and position, written."""
    cols = [F.col(q(c)) for c in order]
    keys = [c.desc() for c in cols] if descending else [c.asc() for c in cols]
    n_parts = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n_parts), *keys).sortWithinPartitions(*keys)
    return written(ranged.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))


def _offsets(counts) -> dict[int, int]:
    """Rows before each partition, from (partition, count) rows."""
    out, run = {}, 0
    for pid, c in sorted((r[0], r[1]) for r in counts):
        out[pid] = run
        run += c
    return out


def _position(offsets: dict[int, int]) -> Column:
    """0-based global position of a row of ``_ranged``."""
    off = F.element_at(F.create_map(*[x for pid in offsets for x in (F.lit(pid), F.lit(offsets[pid]))]), F.col("_pid")) \
        if offsets else F.lit(0)
    return off + F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
