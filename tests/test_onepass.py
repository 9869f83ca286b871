"""Slices of the one-pass sums against the reports by themselves."""

import pytest

from profitloom import catalog
from profitloom.operators import lines as L
from profitloom.plans import onepass
from profitloom.sources.tables import ShopTables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sums(spark):
    shop = ShopTables(spark, SF_DIR)
    return onepass.report_sums(L.active(catalog._all_orders_and_first_line(shop), shop.cfg)).persist()


@pytest.mark.parametrize("name", ["weekly_profit", "weekly_aov", "daily_orders", "payment_summary", "city_top", "discount_usage"])
def test_slice_equals_its_report(spark, sums, name):
    shop = ShopTables(spark, SF_DIR)
    slice_of = getattr(onepass, name)
    got = slice_of(sums, shop.cfg) if name == "city_top" else slice_of(sums)
    want = catalog.all_queries()[name](spark, SF_DIR)
    assert got.dtypes == want.dtypes
    assert got.collect() == want.collect()


def test_one_scan_and_one_exchange_more(spark):
    shop = ShopTables(spark, SF_DIR)
    orders = L.active(catalog._all_orders_and_first_line(shop), shop.cfg)
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    both = plan(onepass.report_sums(orders))
    assert both.count("lineitem.parquet") == 1
    assert both.count("Exchange hash") <= plan(orders).count("Exchange hash") + 1
