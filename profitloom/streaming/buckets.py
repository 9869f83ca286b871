"""A log of keyed rows in buckets, so that a batch reads only the buckets that it touches.

A bucket is a run of ``SPAN`` keys, which for running numbers keeps rows of one time together and is
bounded however long the history gets. Every batch writes a folder of its own with one folder per
bucket; what a batch touched is read off the folders' names. Once a bucket has ``FAN`` pieces they are
merged into one; a merged piece carries the number of the batch that made it and stands for all
pieces up to that batch. Nothing is overwritten but by the same batch run again, which writes the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructType

#: Keys in a bucket.
SPAN = 1 << 16
#: Pieces of a bucket that are merged into one.
FAN = 16


def bucket_of(key: str, span: int = SPAN) -> str:
    """The bucket of a key; rows without one share a bucket."""
    return f"coalesce({key} div {span}, -1L)"


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern in whatever file system holds them, without reading any file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath()) for status in found or []]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file as a mark."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()


def in_buckets(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by ``bucket`` for writing; adaptive execution splits a large bucket."""
    return rows.hint("rebalance", "bucket")


def write_buckets(rows: DataFrame, path: str) -> None:
    in_buckets(rows).write.mode("overwrite").partitionBy("bucket").parquet(path)


class BucketLog:
    """Rows with the columns ``schema``, by batch and bucket; reading adds their ``batch``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self.logged, self.merged = self._listed("log"), self._listed("merged")

    def _listed(self, kind: str) -> dict[int, set[int]]:
        """Batches by bucket."""
        out: dict[int, set[int]] = {}
        for name in folders(self.spark, f"{self.path}/{kind}/batch=*/bucket=*"):
            batch, bucket = re.search(r"batch=(\d+)/bucket=(-?\d+)$", name).groups()
            out.setdefault(int(bucket), set()).add(int(batch))
        return out

    def _note(self, kind: str, batch: int, held: dict[int, set[int]]) -> list[int]:
        """Take a batch's folders into account; its buckets."""
        for batches in held.values():
            batches.discard(batch)
        found = folders(self.spark, f"{self.path}/{kind}/batch={batch}/bucket=*")
        buckets = sorted(int(name.rpartition("=")[2]) for name in found)
        for bucket in buckets:
            held.setdefault(bucket, set()).add(batch)
        return buckets

    def append(self, rows: DataFrame, batch: int, key: str, span: int = SPAN) -> list[int]:
        """Log a batch's rows; the buckets they touch. What the same batch wrote before no longer counts."""
        for batches in self.merged.values():
            batches.difference_update([b for b in batches if b >= batch])
        write_buckets(rows.selectExpr("*", f"{bucket_of(key, span)} as bucket"), f"{self.path}/log/batch={batch}")
        return self._note("log", batch, self.logged)

    def _pieces(self, bucket: int, upto: int) -> tuple[int | None, list[int]]:
        """The last merged piece of a bucket as of batch ``upto``, and the batches after it."""
        base = max((b for b in self.merged.get(bucket, ()) if b <= upto), default=None)
        return base, sorted(b for b in self.logged.get(bucket, ()) if (base is None or b > base) and b <= upto)

    def pieces(self, bucket: int, upto: int) -> list[str]:
        """The folders that hold a bucket as of batch ``upto``."""
        base, later = self._pieces(bucket, upto)
        return [self._folder("merged", base, bucket)] * (base is not None) + [self._folder("log", b, bucket) for b in later]

    def _folder(self, kind: str, batch: int, bucket: int) -> str:
        return f"{self.path}/{kind}/batch={batch}/bucket={bucket}"

    def _open(self, kind: str, pieces: list[tuple[int, int]]) -> DataFrame:
        paths = [self._folder(kind, batch, bucket) for batch, bucket in pieces]
        names = [*self.schema.names, "batch"]
        if not paths:
            return self.spark.createDataFrame([], StructType([*self.schema]).add("batch", LongType()))
        reader = self.spark.read.schema(StructType([*self.schema]).add("batch", LongType()).add("bucket", LongType()))
        return reader.option("basePath", f"{self.path}/{kind}").parquet(*paths).select(*names)

    def folder(self, batch: int, bucket: int) -> str:
        """Where a batch logged a bucket's rows."""
        return self._folder("log", batch, bucket)

    def open(self, pieces: list[tuple[int, int]]) -> DataFrame:
        """What was logged, by (batch, bucket)."""
        return self._open("log", pieces)

    def of_batch(self, buckets: list[int], batch: int) -> DataFrame:
        """What a batch logged in the buckets."""
        return self.open([(batch, b) for b in buckets if batch in self.logged.get(b, ())])

    def read(self, buckets: list[int], upto: int) -> DataFrame:
        """All rows of the buckets as of batch ``upto``; no other folder is opened."""
        found = {bucket: self._pieces(bucket, upto) for bucket in buckets}
        merged = [(base, bucket) for bucket, (base, _) in found.items() if base is not None]
        logged = self._open("log", [(b, bucket) for bucket, (_, later) in found.items() for b in later])
        return self._open("merged", merged).unionByName(logged) if merged else logged

    def merge(self, buckets: list[int], batch: int, keep: Callable[[DataFrame], DataFrame], key: str, span: int = SPAN) -> None:
        """Write buckets of ``FAN`` pieces or more as one, with the rows that ``keep`` leaves of them."""
        full = [b for b in buckets if len(self.pieces(b, batch)) >= FAN]
        if not full:
            return
        rows = keep(self.read(full, batch)).select(*self.schema.names).selectExpr("*", f"{bucket_of(key, span)} as bucket")
        write_buckets(rows, f"{self.path}/merged/batch={batch}")
        self._note("merged", batch, self.merged)

    def vacuum(self, upto: int) -> None:
        """Delete the pieces that no batch after ``upto`` reads; that batch must be over."""
        for bucket in sorted({*self.logged, *self.merged}):
            base, later = self._pieces(bucket, upto)
            for kind, held, live in (("log", self.logged, later), ("merged", self.merged, [base])):
                for batch in [b for b in held.get(bucket, ()) if b <= upto and b not in live]:
                    remove(self.spark, self._folder(kind, batch, bucket))
                    held[bucket].discard(batch)
