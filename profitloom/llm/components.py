"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, root) for the vertices of edges (a, b): the smallest vertex each can reach.

    Every round hangs the larger neighbours of each vertex, then the smaller ones, on the
    smallest; the number of rounds grows with the logarithm of the size of a component. Each
    round is written to the shared folder. Vertices with many edges spread as rows of a join
    that adaptive execution can split.
    """
    spark = edges.sparkSession
    now = stored(
        spark,
        edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.union(now.select("u", "v"))
        least = both.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        least = least.select("x", F.least("x", "m").alias("m"))
        # Large star: larger neighbours of v go to the smallest neighbour of v.
        large = both.toDF("x", "n").where("n > x").join(least, "x").select(F.col("n").alias("v"), F.col("m").alias("u"))
        large = stored(spark, large.where("v != u").distinct(), "edges")
        # Small star: v and its smaller neighbours go to the smallest of them.
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = stored(spark, small.union(lowest.select("v", F.col("m").alias("u"))).where("v != u").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.groupBy("v").agg(F.min("u").alias("root"))
    return roots.union(roots.select("root").distinct().select(F.col("root").alias("v"), "root"))
