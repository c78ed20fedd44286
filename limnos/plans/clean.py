"""Minimum slice: clean a measurement table and report its quality.

read -> drop rows with a null target -> sequential IQR fences -> describe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from limnos.operators.outliers import iqr_filter
from limnos.operators.profile import describe
from limnos.operators.schema import drop_missing


def clean_measurements(df: DataFrame, target: str, fence_cols: Sequence[str], k: float = 3.0,
                       report: list | None = None) -> DataFrame:
    """Drop null targets, then apply the sequential IQR fences (J1) in order."""
    return iqr_filter(drop_missing(df, [target]), fence_cols, k=k, report=report)


def clean_and_describe(df: DataFrame, target: str, fence_cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Describe (D3) the fence columns of the cleaned table."""
    return describe(clean_measurements(df, target, fence_cols, k), list(fence_cols))
