"""Line and order tables on disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.functions.frames import grouped

#: Lines of an order that one task takes; longer orders are left to joins that adaptive execution splits.
ORDER_LINES = 1 << 16


def write_table(
    df: DataFrame, path: str, *keys: str, shape: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Parquet by order month, ranged on the day and the table's own keys.

    With the full key in the range, one very busy day or order still spreads over
    many tasks; sorted files let readers skip by day inside a month. ``shape`` turns the
    rows into those of the table after they are ranged, so that narrow rows travel; it
    leaves them in their task.
    """
    order = ["order_date", *keys]
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    if shape is not None:
        ranged = shape(ranged)
    (
        ranged.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
        .sortWithinPartitions(*order)
        .write.partitionBy("order_month")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("order_month")


@contextmanager
def lines_by_order(
    headers: DataFrame, lines: DataFrame, keys: DataFrame, folder: str, order_lines: int | None = None
) -> Iterator[list[tuple[DataFrame, DataFrame]]]:
    """Headers and lines, stored once in buckets of order numbers, so that several tables are made of them without
    exchanging lines again.

    ``keys`` has the order number of every line. Orders of more than ``order_lines`` (``ORDER_LINES``) lines, whose
    list is short, are a second pair of headers and lines that lie anywhere. Lines without an order number, which meet
    no header, are left out. The buckets are in the catalog as long as the context lasts; their files stay.
    """
    spark, known = headers.sparkSession, "order_number is not null"
    headers, lines = headers.filter(known), lines.filter(known)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = grouped(keys.filter(known), ["order_number"], "count(1) as n").filter(f"n > {order_lines or ORDER_LINES}").select("order_number")
    counts.write.parquet(f"{folder}/long")
    long = spark.read.schema(counts.schema).parquet(f"{folder}/long")
    some = not long.isEmpty()
    name = f"lines_{uuid.uuid4().hex}"
    short = lines.join(long, "order_number", "left_anti") if some else lines
    dealt = short.repartition(buckets, "order_number").write.bucketBy(buckets, "order_number").sortBy("order_number")
    dealt.format("parquet").option("compression", "zstd").option("path", f"{folder}/short").saveAsTable(name)
    try:
        pairs = [(headers.repartition(buckets, "order_number"), spark.table(name))]
        if some:
            lines.join(long, "order_number", "left_semi").write.parquet(f"{folder}/rest")
            rest = spark.read.schema(lines.schema).parquet(f"{folder}/rest")
            pairs.append((headers.join(long, "order_number", "left_semi"), rest))
        yield pairs
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
