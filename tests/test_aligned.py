"""Aligned tables: equal to the unstored results, joined without an exchange, huge orders spread."""

import pytest

from profitloom import catalog
from profitloom.operators import lines as L
from profitloom.operators import orders as O
from profitloom.plans import lists
from profitloom.sources import fees, sheets
from profitloom.sources.aligned import write_aligned
from profitloom.sources.tables import ShopTables
from profitloom.storage import new_folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return ShopTables(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(spark, shop):
    charged = fees.card_fees_by_order(shop.card_transactions())
    # Small pages, so that most orders have several.
    return write_aligned(shop.headers(True), shop.lines(), charged, shop.cfg, shop.cost_lookup(), new_folder(spark, "aligned"), 5, 2)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plan(spark, frame):
    """The plan as first made, before adaptive execution, without broadcasts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_lines_equal_those_made_anew_and_meet_their_order_without_exchange(spark, shop, stored):
    same(stored.allocated(), L.allocate(shop.headers(True), shop.lines()))
    found = plan(spark, stored.allocated())
    assert "Exchange" not in found and found.count("Bucketed: true") == 2 and "SortMergeJoin" in found


def test_orders_and_fees_meet_without_exchange(spark, shop, stored):
    same(stored.orders(), O.order_table(shop.headers(True), shop.lines(), shop.cfg, shop.cost_lookup()))
    found = plan(spark, O.with_actual_fee(stored.orders(), stored.table("fees")))
    assert "Exchange" not in found and found.count("Bucketed: true") == 2
    rules = sheets.fee_rules(shop.per_order_sheet())
    wallet = catalog._wallet(shop)
    want = catalog._with_fee(shop, O.order_table(shop.headers(True), shop.lines(), shop.cfg, shop.cost_lookup()))
    same(stored.with_fee(wallet, rules, shop.cfg), want)
    # The list of orders is sorted, which is its only exchange.
    found = plan(spark, lists.orders_summary(L.active(stored.orders(), shop.cfg)))
    assert "Exchange hash" not in found and "Join" not in found and found.count("Exchange") == 1


def test_a_huge_order_lies_in_many_buckets(spark, shop):
    one = shop.lines().limit(1).drop("line_pos").crossJoin(spark.range(3000).selectExpr("cast(id as decimal(38,0)) as line_pos"))
    lines = one.select(*shop.lines().columns)
    charged = fees.card_fees_by_order(shop.card_transactions())
    folder = new_folder(spark, "aligned")
    tables = write_aligned(shop.headers(True), lines, charged, shop.cfg, shop.cost_lookup(), folder, 8, 100)
    pages = tables.table("lines").groupBy("page").count().collect()
    assert len(pages) == 30 and max(r["count"] for r in pages) < 200
    files = tables.table("lines").selectExpr("input_file_name() as f").distinct().count()
    assert files > 4
    same(tables.allocated(), L.allocate(shop.headers(True), lines))


def test_empty_tables_and_drop(spark, shop):
    charged = fees.card_fees_by_order(shop.card_transactions()).limit(0)
    tables = write_aligned(shop.headers(True).limit(0), shop.lines().limit(0), charged, shop.cfg, shop.cost_lookup(), new_folder(spark, "aligned"))
    assert tables.allocated().isEmpty() and tables.orders().isEmpty()
    tables.drop()
    assert not spark.catalog.tableExists(f"{tables.prefix}_lines")


def test_lines_are_dealt_without_another_exchange(spark, shop):
    from profitloom.sources.aligned import _paged, _several

    lines = shop.lines()
    paged = _paged(lines, _several(lines, 1 << 16, new_folder(spark, "aligned")))
    found = paged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in found and "SortMergeJoin" not in found
