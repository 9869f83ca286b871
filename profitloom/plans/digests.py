"""Which rows differ between two tables, found by a tree of digests over key ranges (Q3).

A range's digest is the number of its rows and the sum of their hashes, so it doesn't depend on the
order of rows or on how they are partitioned, and the digest of a wider range is the sum of its
parts. One pass over a table writes its lowest ranges; the levels above come from these. Two tables
are compared from the top: only ranges that differ are opened further, and rows are read again only in
the lowest ranges that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.functions.frames import grouped
from profitloom.storage import new_folder

#: Keys in a lowest range, ranges in the next wider one, and levels above the lowest.
SPAN, FAN, LEVELS = 256, 32, 4
_SCHEMA = "node bigint, n bigint, digest decimal(38,0)"


def row_digest(columns: list[str]) -> str:
    """Hash of a row; a missing value differs from every other."""
    parts = ", ".join(f"coalesce(concat('=', cast({c} as string)), '-')" for c in columns)
    return f"cast(xxhash64({parts}) as decimal(38,0))"


@dataclass(frozen=True)
class DigestTree:
    """Digests of a table by key ranges, below ``path``."""

    spark: SparkSession
    path: str

    def level(self, height: int) -> DataFrame:
        """(node, n, digest) of the ranges of a height; 0 are the lowest."""
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{height}")


def build_tree(rows: DataFrame, key: str, columns: list[str]) -> DigestTree:
    """Read a table once and write the digests of its ranges; rows without a key share a range."""
    tree = DigestTree(rows.sparkSession, new_folder(rows.sparkSession, "digests"))
    sums = "count(1) as n", "sum(digest) as digest"
    low = grouped(rows.selectExpr(f"{key} div {SPAN} as node", f"{row_digest([key, *columns])} as digest"), ["node"], *sums)
    low.selectExpr("node", "n", "cast(digest as decimal(38,0)) as digest").write.parquet(f"{tree.path}/0")
    for height in range(1, LEVELS + 1):
        wider = grouped(tree.level(height - 1).selectExpr(f"node div {FAN} as node", "n", "digest"), ["node"],
                        "sum(n) as n", "cast(sum(digest) as decimal(38,0)) as digest")
        wider.write.parquet(f"{tree.path}/{height}")
    return tree


def differing_ranges(left: DigestTree, right: DigestTree) -> DataFrame:
    """The lowest ranges (node) in which two tables differ, by descent from the widest."""
    open_ = None
    for height in range(LEVELS, -1, -1):
        sides = []
        for tree, sign in ((left, 1), (right, -1)):
            nodes = tree.level(height)
            if open_ is not None:
                inside = nodes.withColumn("_up", F.expr(f"node div {FAN}"))
                nodes = inside.join(open_, inside["_up"].eqNullSafe(open_["node_up"]), "left_semi").drop("_up")
            sides.append(nodes.selectExpr("node", f"n * {sign} as n", f"digest * {sign} as digest"))
        apart = grouped(sides[0].unionByName(sides[1]), ["node"], "sum(n) as n", "sum(digest) as digest")
        open_ = apart.filter("n <> 0 or digest <> 0").selectExpr("node as node_up")
    return open_.withColumnRenamed("node_up", "node")


def differing_rows(
    left: DataFrame, right: DataFrame, ranges: DataFrame, key: str, columns: list[str]
) -> DataFrame:
    """(key, difference) of the keys whose rows differ: ``changed``, or ``missing`` on one side."""
    sides = []
    for rows, sign in ((left, 1), (right, -1)):
        rows = rows.selectExpr(f"{key} as key", f"{key} div {SPAN} as node", f"{row_digest([key, *columns])} as digest")
        rows = rows.join(ranges.withColumnRenamed("node", "open"), rows["node"].eqNullSafe(F.col("open")), "left_semi")
        sides.append(rows.selectExpr("key", f"{sign} as side", f"digest * {sign} as digest"))
    sums = grouped(
        sides[0].unionByName(sides[1]), ["key"], "count_if(side = 1) as a", "count_if(side = -1) as b", "sum(digest) as digest"
    )
    what = "case when a = 0 then 'missing left' when b = 0 then 'missing right' else 'changed' end as difference"
    return sums.filter("a <> b or digest <> 0").selectExpr("key", what)
