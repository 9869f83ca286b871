"""The current orders as a bucketed table, kept up to date by upserts.

New pages go to a log in buckets of order ids. A refresh merges what is new with the buckets it
falls into and overwrites just these; all others keep their files. The table holds, beside each page
of an order's newest version, the sums over all pages of the order, so readers open it once
and join nothing. Merged buckets are written aside first and put in place from there, so a refresh that
breaks off is taken up by the next one, and nothing is lost between the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profitloom.functions.frames import grouped
from profitloom.functions.money import cast
from profitloom.operators.lines import PAGE_SUMS, SUM_TYPE
from profitloom.schemas import ORDER
from profitloom.sources.orders import FIRST_LINE, VERSION
from profitloom.streaming.buckets import SPAN, BucketLog, bucket_of, folders, in_buckets, remove, touch, write_buckets
from profitloom.streaming.log import newest

_SUMS = {"n_lines": "long", "items_value": SUM_TYPE, "own_discount": SUM_TYPE}
STORED = StructType([*ORDER])
for _name, _kind in _SUMS.items():
    STORED = STORED.add(_name, _kind)
_OWN = [f"{PAGE_SUMS[name]} as {name}" for name in _SUMS]


def latest_pages(rows: DataFrame) -> DataFrame:
    """Of rows ``ORDER`` and ``batch``, the pages of each order's newest version with the order's sums.

    Versions are told apart by the instant of their change; of a page that came again in the same
    version the later batch counts. What stays is found on narrow columns, which alone are grouped,
    and each document travels once. A page without an order id is an order by itself.
    """
    keyed = rows.selectExpr("*", f"{FIRST_LINE} as _page", f"{VERSION} as _version")
    pages = grouped(
        keyed.filter("id is not null").selectExpr("id", "_page", "_version", "batch", *_OWN),
        ["id", "_page", "_version"],
        *[f"max_by({name}, batch) as {name}" for name in _SUMS],
        "max(batch) as batch",
    )
    best = grouped(pages, ["id"], "max(_version) as _version")
    pages = pages.join(best, ["id", "_version"], "left_semi")
    sums = grouped(pages, ["id"], *[f"{cast(f'sum({name})', kind)} as {name}" for name, kind in _SUMS.items()])
    kept = pages.drop(*_SUMS).join(sums, "id")
    named = keyed.join(kept, ["id", "_page", "_version", "batch"]).select(*STORED.names)
    alone = rows.filter("id is null").selectExpr("*", *_OWN).select(*STORED.names)
    return named.unionByName(alone)


@dataclass(frozen=True)
class Refresh:
    """Batches up to ``upto`` are merged; ``buckets`` were written for it."""

    upto: int
    buckets: list[int]


class OrderStore:
    """Log and table below one path."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN):
        self.spark, self.path, self.span = spark, path, span
        self.log = BucketLog(spark, f"{path}/feed", ORDER)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Log the newest version of every page of a batch."""
        # Documents without an id are told apart by all that they say.
        alone = "if(id is null, xxhash64(*), 0L) as _alone"
        rows = newest(batch.selectExpr("*", alone), ["id", "first_line", "_alone"], F.expr(VERSION))
        self.log.append(rows.select(*ORDER.names), batch_id, "id", self.span)

    def merged_upto(self) -> int:
        """The last batch that the table holds; -1 before the first."""
        return max((int(name.rpartition("/")[2]) for name in folders(self.spark, f"{self.path}/merged/*")), default=-1)

    def _put_in_place(self, upto: int) -> None:
        """Overwrite the buckets written aside, and no other."""
        aside = f"{self.path}/aside/upto={upto}"
        rows = self.spark.read.schema(StructType([*STORED]).add("bucket", "long")).parquet(aside)
        writer = in_buckets(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/current")
        touch(self.spark, f"{self.path}/merged/{upto}")
        remove(self.spark, aside)

    def _finish(self) -> int:
        """Take up a refresh that broke off after its buckets were written; the last batch merged."""
        done = self.merged_upto()
        for name in folders(self.spark, f"{self.path}/aside/upto=*/_SUCCESS"):
            upto = int(name.split("upto=")[1].partition("/")[0])
            if upto > done:
                self._put_in_place(upto)
                done = upto
        return done

    def _new(self, done: int) -> dict[int, list[int]]:
        """Batches after ``done`` by bucket."""
        found = {bucket: sorted(n for n in batches if n > done) for bucket, batches in self.log.logged.items()}
        return {bucket: batches for bucket, batches in found.items() if batches}

    def _versions(self, held: list[str], new: dict[int, list[int]]) -> DataFrame:
        """Pages of the table's folders and of the log's batches."""
        rows = self.log.open([(n, bucket) for bucket, batches in new.items() for n in batches])
        if held:
            old = self.spark.read.schema(ORDER).parquet(*held).select(*ORDER.names).selectExpr("*", "-1L as batch")
            rows = old.unionByName(rows)
        return rows

    def refresh(self) -> Refresh:
        """Merge the log's new batches into the buckets they touch."""
        done = self._finish()
        new = self._new(done)
        if not new:
            return Refresh(done, [])
        upto = max(batches[-1] for batches in new.values())
        there = {int(n.rpartition("=")[2]): n for n in folders(self.spark, f"{self.path}/current/bucket=*")}
        rows = latest_pages(self._versions([there[b] for b in new if b in there], new))
        write_buckets(rows.selectExpr("*", f"{bucket_of('id', self.span)} as bucket"), f"{self.path}/aside/upto={upto}")
        self._put_in_place(upto)
        return Refresh(upto, sorted(new))

    def read(self) -> DataFrame:
        """All current pages with their order's sums: the table, with what was logged since on top."""
        done = self._finish()
        new, there = self._new(done), folders(self.spark, f"{self.path}/current/bucket=*")
        if new:
            return latest_pages(self._versions(there, new))
        if not there:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{self.path}/current").select(*STORED.names)

    def vacuum(self) -> None:
        """Delete what is logged and merged."""
        done = self.merged_upto()
        for bucket, batches in self.log.logged.items():
            for n in [n for n in batches if n <= done]:
                remove(self.spark, self.log.folder(n, bucket))
                batches.discard(n)
