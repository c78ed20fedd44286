"""Joins (E1, E3, E4).

* ``enrich_left_join`` (E1): de-duplicate the right side on its keys (so the
  left row count is preserved), then left equi-join.  The right side is
  broadcast only after its row count is checked against a bound; beyond it
  the join is a shuffle join (AQE may still convert it at run time).
* ``value_grid`` (E3): a cross product of value lists built by exploding
  literal arrays -- a generator, not a join; its size is checked.
* ``with_scalar_stats`` (E4) lives in ``outliers`` and attaches one-row
  statistics as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.outliers import with_scalar_stats  # noqa: F401  (E4)
from limnos.operators.profile import q

BROADCAST_MAX_ROWS = 2_000_000


def dedupe_right(right: DataFrame, keys: Sequence[str], value_cols: Sequence[str], how: str = "avg") -> DataFrame:
    """One row per key: values averaged (or first non-null) over duplicates."""
    fn = {"avg": F.avg, "first": lambda c: F.first(c, ignorenulls=True), "max": F.max, "min": F.min}[how]
    return right.groupBy(*keys).agg(*[fn(F.col(q(v))).alias(v) for v in value_cols])


def enrich_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                     dedupe: str = "avg", broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                     round_keys: Mapping[str, int] | None = None) -> DataFrame:
    """Left join ``value_cols`` from ``right`` on ``keys``; unmatched -> null.

    ``round_keys`` rounds float keys (e.g. lat/lon to 2 digits) on both
    sides before matching.  The right side is de-duplicated first; its row
    count decides broadcast (<= ``broadcast_max_rows``) vs shuffle join.
    """
    if round_keys:
        rk = {k: F.round(F.col(q(k)), d) for k, d in round_keys.items()}
        left = left.withColumns({f"_k_{k}": e for k, e in rk.items()})
        right = right.withColumns({f"_k_{k}": F.round(F.col(q(k)), d) for k, d in round_keys.items()})
        join_keys = [f"_k_{k}" if k in round_keys else k for k in keys]
        right = right.drop(*[k for k in keys if k in round_keys])
    else:
        join_keys = list(keys)
    small = dedupe_right(right, join_keys, value_cols, dedupe)
    n_right = small.limit(broadcast_max_rows + 1).count()
    if n_right <= broadcast_max_rows:
        small = F.broadcast(small)
    out = left.join(small, on=join_keys, how="left")
    if round_keys:
        out = out.drop(*[f"_k_{k}" for k in round_keys])
    return out


def value_grid(spark: SparkSession, axes: Mapping[str, Sequence[float]], max_points: int = 1_000_000,
               with_index: bool = False) -> DataFrame:
    """Every combination of the axis values, one row each.

    ``with_index`` adds ``<axis>__i`` (0-based level position) per axis.
    """
    size = int(np.prod([len(v) for v in axes.values()]))
    if size > max_points:
        raise ValueError(f"grid of {size} points exceeds {max_points}")
    row = spark.range(1)
    for name, vals in axes.items():
        row = row.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in vals])).alias(f"{name}__i", name))
    row = row.drop("id")
    return row if with_index else row.drop(*[f"{n}__i" for n in axes])


def data_grid(df: DataFrame, levels: Mapping[str, int], fixed: Mapping[str, float] | None = None,
              max_points: int = 1_000_000, with_index: bool = False) -> DataFrame:
    """E3 over data ranges: ``levels[c]`` evenly spaced values from min(c) to max(c)."""
    cols = list(levels)
    row = df.agg(*[F.min(F.col(q(c))).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(q(c))).alias(f"hi{i}") for i, c in enumerate(cols)]).collect()[0]
    axes = {}
    for i, c in enumerate(cols):
        lo, hi, n = float(row[f"lo{i}"]), float(row[f"hi{i}"]), levels[c]
        axes[c] = [lo + (hi - lo) * j / (n - 1) for j in range(n)] if n > 1 else [lo]
    grid = value_grid(df.sparkSession, axes, max_points, with_index)
    if fixed:
        grid = grid.withColumns({k: F.lit(float(v)) for k, v in fixed.items()})
    return grid
