"""Scalar column functions.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero divisor (Spark 4 raises under ANSI)."""
    return F.try_divide(_c(num), _c(den))


def ln_offset(x, offset: float = 1e-5) -> Column:
    """``ln(x + offset)``; Spark returns NULL where NumPy returns -inf."""
    return F.ln(_c(x) + F.lit(offset))


def clip(x, lo, hi) -> Column:
    """Bound ``x`` to [lo, hi]; a NULL ``x`` stays NULL (least/greatest skip nulls)."""
    x = _c(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, lo), hi))


def weekday0(ts) -> Column:
    """Day of week with Monday = 0 (pandas convention); not ``dayofweek``."""
    return F.weekday(_c(ts))


def nan_to_null(x) -> Column:
    """NaN is a value in Spark (sorts last, poisons avg); make it NULL."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def key_string(*keys) -> Column:
    """Stable text form of a (compound) integer key: ``k1|k2|...``.

    Only integer and string keys are allowed for hashing: double-to-text
    differs between engines.
    """
    cols = [_c(k).cast("string") for k in keys]
    return cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)


def hash_bucket(keys: Iterable | str | Column, modulo: int = 100, salt: str | None = None) -> Column:
    """Deterministic bucket in [0, modulo) from md5 of the key text.

    Depends only on the key, not on partitioning or task order, so splits,
    folds and masks are reproducible on any cluster layout and in SQL:
    ``cast(conv(substr(md5(k), 1, 8), 16, 10) as bigint) % modulo``.
    """
    if isinstance(keys, (str, Column)):
        keys = [keys]
    text = key_string(*keys)
    if salt is not None:
        text = F.concat(text, F.lit(":" + salt))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(modulo)).cast("bigint")


def json_field(col, path: str) -> Column:
    """Value at a JSON path (``$.a.b``) of a JSON text column, as text."""
    return F.get_json_object(_c(col), path)


def normalise_text(col, strip_chars: str | None = None) -> Column:
    """Trim and lower-case (optionally remove ``strip_chars``)."""
    x = F.lower(F.trim(_c(col)))
    if strip_chars:
        x = F.translate(x, strip_chars, "")
    return x
