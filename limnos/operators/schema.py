"""Schema operations, projections and filters.

Projections and filters are plain ``select``/``where`` so Catalyst prunes
columns and pushes predicates into the Parquet scan.  Decisions that need
data (empty columns, datetime discovery) take one fused aggregate.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.profile import numeric_columns, q, string_columns


def require_columns(df: DataFrame, cols: Sequence[str], mode: str = "all") -> list[str]:
    """B1: plan-time column check (no job).

    ``mode="all"``: raise listing every missing column.  ``mode="any"``:
    warn on partial absence, raise only if none exists; returns the
    present columns.
    """
    present = [c for c in cols if c in df.columns]
    missing = [c for c in cols if c not in df.columns]
    if mode == "all" and missing:
        raise ValueError(f"missing required columns: {missing}")
    if mode == "any":
        if not present:
            raise ValueError(f"none of the columns exist: {list(cols)}")
        if missing:
            warnings.warn(f"columns not found, skipped: {missing}", stacklevel=2)
    return present


def bind_roles(df: DataFrame, roles: Mapping[str, str], keep_others: bool = False) -> DataFrame:
    """B2: expose caller-named columns under role names (e.g. chl, temp, do)."""
    require_columns(df, list(roles.values()))
    bound = [F.col(q(src)).alias(role) for role, src in roles.items()]
    if keep_others:
        used = set(roles.values())
        bound = [F.col(q(c)) for c in df.columns if c not in used] + bound
    return df.select(*bound)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map (absent names are ignored, as in pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep listed columns, in that order."""
    return df.select(*[F.col(q(c)) for c in cols])


def project_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keep columns by 1-based position (R style)."""
    return df.select(*[F.col(q(df.columns[i - 1])) for i in positions])


def project_numeric(df: DataFrame) -> DataFrame:
    """Keep numeric columns only."""
    return df.select(*[F.col(q(c)) for c in numeric_columns(df)])


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Boolean filter, e.g. ``(a & b) | c | d``."""
    return df.where(condition)


def filter_membership(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose ``col`` is in ``values``."""
    return df.where(F.col(q(col)).isin(list(values)))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with a null in ``subset`` (or in any column)."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Remove columns that are entirely null (one aggregate decides)."""
    if not df.columns:
        return df
    row = df.agg(*[F.count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(df.columns)]).collect()[0]
    empty = [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]
    return df.drop(*empty)


def unit_scale(df: DataFrame, col: str, factor: float = 1.0, offset: float = 0.0,
               out: str | None = None) -> DataFrame:
    """``x * factor - offset`` (e.g. ug/L -> mg/L with 0.001); null stays null."""
    return df.withColumn(out or col, F.col(q(col)) * F.lit(factor) - F.lit(offset))


def validate_nonnegative(df: DataFrame, cols: Sequence[str], strict: bool = False):
    """Split rows into (accepted, quarantined) by ``x >= 0`` on every column.

    Null is accepted (it is missing, not negative).  ``strict=True``
    instead raises on the first negative value via ``assert_true`` when the
    returned frame is evaluated.
    """
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.col(q(c)) < 0, F.lit(False))
    if strict:
        return df.where(F.assert_true(~bad, F.lit(f"negative value in {list(cols)}")).isNull())
    return df.where(~bad), df.where(bad)


def datetime_columns(df: DataFrame, fmt: str | None = None) -> list[str]:
    """String columns whose every non-null value parses as a timestamp."""
    cols = string_columns(df)
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(q(c))
        parsed = F.try_to_timestamp(x, F.lit(fmt)) if fmt else F.try_to_timestamp(x)
        aggs += [F.count(x).alias(f"n{i}"), F.count(parsed).alias(f"p{i}")]
    row = df.agg(*aggs).collect()[0]
    return [c for i, c in enumerate(cols) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"]]


def normalise_date(df: DataFrame, col: str, out: str | None = None, key_out: str | None = None) -> DataFrame:
    """Any timestamp -> ``date`` (and an optional ``yyyyMMdd`` text key)."""
    d = F.to_date(F.col(q(col)))
    df = df.withColumn(out or col, d)
    if key_out:
        df = df.withColumn(key_out, F.date_format(F.col(q(out or col)), "yyyyMMdd"))
    return df


def cast_types(df: DataFrame, types: Mapping[str, T.DataType | str]) -> DataFrame:
    """Explicit per-column casts (``try_cast``: unparseable -> null)."""
    return df.withColumns({c: F.col(q(c)).try_cast(t) for c, t in types.items()})
