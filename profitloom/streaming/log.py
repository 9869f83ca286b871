"""An append-only table of versions, one folder per micro-batch.

A batch that is run again after a failure writes the same folder again, and nothing
already committed is ever changed, so readers and restarts see whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def newest(df: DataFrame, key: str | list[str], *version: Column) -> DataFrame:
    """The row with the highest version per key, as an aggregate.

    Combining before the shuffle keeps one row per key and task, however many
    versions a key has.
    """
    keys = [key] if isinstance(key, str) else key
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(*version)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same for numbers, days and flags, without ``order``: such an aggregate hashes instead of sorting."""
    others = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in others])


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function that appends ``shape(batch)`` under its batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of all batches, with their batch number; no rows before the first."""
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
