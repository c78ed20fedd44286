"""Long <-> wide reshaping.

Pivots always take an explicit value list (no extra distinct job, fixed
output schema).  If the caller does not pass one, the distinct levels are
fetched once and capped by ``max_levels`` -- a pivot column per level
must stay a bounded schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.operators.ranking import rank_within_groups


def _levels(df: DataFrame, key: str, values: Sequence | None, max_levels: int) -> list:
    if values is not None:
        return list(values)
    levels = [r[0] for r in df.select(key).distinct().limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{key} has more than {max_levels} levels; pass the value list")
    return sorted((v for v in levels if v is not None)) + [None] * (None in levels)   # NULL is a level, named "null"


def pivot_aligned(df: DataFrame, key: str, value: str, order_col: str, values: Sequence | None = None,
                  row_col: str = "row_id", max_levels: int = 1000) -> DataFrame:
    """Number rows within each level of ``key`` (by ``order_col``), then
    pivot wide on that number: row i holds the i-th value of every level;
    ragged ends are null.  The row number is kept as ``row_col``.
    """
    levels = _levels(df, key, values, max_levels)
    numbered = rank_within_groups(df.select(key, value, order_col), key, order_col, out=row_col)
    return numbered.groupBy(row_col).pivot(key, levels).agg(F.first(F.col(q(value))))


def pivot_wide(df: DataFrame, keys: Sequence[str], var: str, value: str, values: Sequence | None = None,
               agg: str = "avg", max_levels: int = 1000) -> DataFrame:
    """(keys) x variable -> one column per variable, value aggregated (avg)."""
    levels = _levels(df, var, values, max_levels)
    fn = {"avg": F.avg, "first": F.first, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    return df.groupBy(*keys).pivot(var, levels).agg(fn(F.col(q(value))))


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None,
                 variable: str = "variable", value: str = "value", dropna: bool = False) -> DataFrame:
    """Columns -> (variable, value) rows; a narrow ``Expand``, no shuffle."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    out = df.unpivot(list(ids), cols, variable, value)
    return out.where(F.col(value).isNotNull()) if dropna else out
