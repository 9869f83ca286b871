"""Line and order tables stored side by side, so that later joins move nothing.

Four tables, each hashed into the same number of buckets by the key it is joined on:

* ``lines`` and ``pages`` by (order_number, page): an order's lines are dealt over as many pages as
  ``PAGE_LINES`` asks for, and each page has the order's fields and sums. Lines meet the fields of
  their order inside a bucket, and an order that holds a large part of all lines lies in many buckets.
* ``orders`` and ``fees`` by order_id: one row per order with its totals, one row per order with the fees charged.

An order without an id stays in ``orders`` and meets no fee. The tables are catalog tables over folders
below the shared one; ``drop`` takes them out of the catalog.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.config import ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import sum_units
from profitloom.operators import lines as L
from profitloom.operators import orders as O
from profitloom.sources.sheets import CostLookup

#: Lines of one order that share a page.
PAGE_LINES = 1 << 16

_LINE_KEY = ("order_number", "page")
_ORDER_KEY = ("order_id",)


@dataclass(frozen=True)
class AlignedTables:
    """Names of the stored tables in the session's catalog."""

    spark: SparkSession
    prefix: str

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def allocated(self) -> DataFrame:
        """Lines with their order's fields, discount share and shipping, as ``lines.allocate`` gives them."""
        joined = self.table("lines").join(self.table("pages"), list(_LINE_KEY))
        return L._allocated(joined, "line_pos = first_pos").drop("first_pos", "page")

    def orders(self) -> DataFrame:
        """The order table; ``orders_summary`` and the other reports need no more than this scan."""
        return self.table("orders")

    def with_fee(self, wallet: DataFrame, rules: DataFrame, cfg: ProfitConfig) -> DataFrame:
        """Orders with the transaction fee charged or estimated."""
        return O.with_txn_fee(self.orders(), self.table("fees"), wallet, rules, cfg)

    def drop(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in ("lines", "pages", "orders", "fees"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def _several(lines: DataFrame, page_lines: int, folder: str) -> DataFrame:
    """Orders of several pages, at most one in ``page_lines`` lines, with ``n_pages``; stored, so that
    Spark knows the list's size and a short one moves neither lines nor headers."""
    counts = grouped(lines, ["order_number"], f"cast(ceil(count(1) / {page_lines}) as bigint) as n_pages")
    listed = counts.filter("n_pages > 1")
    listed.write.parquet(f"{folder}/several")
    return lines.sparkSession.read.schema(listed.schema).parquet(f"{folder}/several")


def _paged(lines: DataFrame, several: DataFrame) -> DataFrame:
    """Lines with their page in the order."""
    place = "if(n_pages is null, 0L, pmod(xxhash64(line_pos, quantity, price_units, discount_units), n_pages)) as page"
    return lines.join(several, "order_number", "left").selectExpr(*lines.columns, place)


def _pages(headers: DataFrame, paged: DataFrame, several: DataFrame, buckets: int) -> DataFrame:
    """One row per page that has lines, with the fields and sums of its order, dealt by page.

    ``paged`` are the stored lines, which are summed where they lie; an order of one page is dealt
    there and meets its sums. Only orders of several pages exchange sums.
    """
    dealt = [F.col(k) for k in _LINE_KEY]
    sums = f"{sum_units(L.VALUE_UNITS)} as items_value", "min(line_pos) as first_pos"
    own = grouped(paged, [*_LINE_KEY], *sums)
    columns = [*headers.columns, "items_value", "first_pos", "page"]
    # Always 0, but no literal: Spark would take that out of the exchange's key, and exchange again.
    first = "pmod(xxhash64(order_number), 1L) as page"
    alone = headers.join(several, "order_number", "left_anti").selectExpr("*", first)
    pages = alone.repartition(buckets, *dealt).join(own, [*_LINE_KEY]).select(*columns)
    if several.isEmpty():
        return pages
    whole = grouped(paged.join(several, "order_number", "left_semi"), ["order_number"], *sums)
    long = headers.join(several, "order_number").join(whole, "order_number")
    long = long.selectExpr(*columns[:-1], "explode(sequence(0L, n_pages - 1)) as page")
    return pages.unionByName(long.repartition(buckets, *dealt))


def write_aligned(
    headers: DataFrame,
    lines: DataFrame,
    card_fees: DataFrame,
    cfg: ProfitConfig,
    costs: CostLookup,
    folder: str,
    buckets: int | None = None,
    page_lines: int = PAGE_LINES,
) -> AlignedTables:
    """Store the four tables below ``folder``; as many buckets as the session has shuffle partitions, if not given."""
    spark = headers.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = AlignedTables(spark, f"aligned_{uuid.uuid4().hex}")

    def write(name: str, dealt: DataFrame, keys: tuple[str, ...], *order: str) -> None:
        writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet")
        writer.option("path", f"{folder}/{name}").saveAsTable(f"{stored.prefix}_{name}")

    def dealt(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The exchange deals rows as buckets do, so a task writes one bucket."""
        return frame.repartition(buckets, *[F.col(k) for k in keys])

    several = _several(lines, page_lines, folder)
    write("lines", dealt(_paged(lines, several), _LINE_KEY), _LINE_KEY, "line_pos")
    # The rest is made from the stored lines: an order's lines lie together, so few rows are exchanged.
    paged = stored.table("lines")
    write("pages", _pages(headers, paged, several, buckets), _LINE_KEY)
    write("orders", dealt(O.order_table(headers, paged.drop("page"), cfg, costs), _ORDER_KEY), _ORDER_KEY)
    write("fees", dealt(card_fees, _ORDER_KEY), _ORDER_KEY)
    return stored
