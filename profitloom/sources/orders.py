"""Order documents.

An order is one or more page documents: each has the order's fields and a bounded run of
its lines, from ``first_line`` on. All pages of a version carry the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from profitloom.functions.frames import grouped
from profitloom.schemas import ORDER

# Instant of a document's last change, so that offsets don't decide which is newer.
VERSION = "coalesce(unix_micros(try_cast(updated_at as timestamp)), 0L)"


#: Place of a page's first line in its order.
FIRST_LINE = "coalesce(first_line, 0L)"


def read_orders(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All landed order pages below the paths as one set, one nested row per page."""
    return spark.read.schema(ORDER).option("recursiveFileLookup", True).json(paths)


def stream_orders(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Order pages as they land."""
    reader = spark.readStream.schema(ORDER).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def newest_orders(docs: DataFrame, version: str = VERSION, page: str = "0L") -> DataFrame:
    """All pages of the newest version of every order, or the newest of every ``page`` of one;
    ``version`` is a whole number or decimal.

    The versions that are out of date are found on narrow columns, and only their list
    meets the documents. A page must not be there twice in one version.
    """
    keys = ["id", "_page"]
    marked = docs.selectExpr("*", f"{version} as version", f"{page} as _page")
    versions = marked.select(*keys, "version")
    best = grouped(versions, keys, "max(version) as best")
    old = versions.join(best, keys).filter("version < best").select(*keys, "version")
    return marked.join(old, [*keys, "version"], "left_anti").select(*docs.columns)
