"""Small helpers for DataFrames built from SQL expression text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: list[str], *aggregates: str) -> DataFrame:
    """Group by expressions (``"expr as name"`` or a column) and aggregate."""
    named = [F.expr(key) for key in keys]
    return df.groupBy(*named).agg(*[F.expr(text) for text in aggregates])
