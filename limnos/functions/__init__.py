"""Column-expression helpers (JVM-side, codegen-friendly) and small
driver-side numeric helpers for one-row statistics."""

from limnos.functions.scalar import (  # noqa: F401
    clip,
    hash_bucket,
    key_string,
    ln_offset,
    nan_to_null,
    safe_div,
    weekday0,
)
