"""The paths taken for hot keys and for lookups too large to broadcast."""

import pytest
from shop import CFG, costs, one

from profitloom.functions.money import from_units, sum_units
from profitloom.operators import lines as L
from profitloom.operators import orders as O
from profitloom.operators.skew import SALTS, left_join_lookup
from profitloom.sources import sheets
from profitloom.sources.tables import ShopTables

SF_DIR = "/root/testdata/sf0.001"


def same(left, right):
    right = right.select(*left.columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """One order with a third of all lines, and one product on most of them."""
    lines = spark.range(3000).selectExpr(
        "if(id < 1000, 7, 100 + id % 500) as order_number",
        "cast(id as int) as line_pos",
        "if(id % 5 < 4, 'A', concat('P', id % 90)) as product_key",
        "if(id % 5 < 4, 'A', concat('P', id % 90)) as product_title",
        "cast(1 + id % 3 as int) as quantity",
        "10000 * (1 + id % 50) as price_units",
        "100 * (id % 7) as discount_units",
    )
    headers = lines.select("order_number").distinct().selectExpr(
        "order_number",
        "order_number as order_id",
        "date'2024-07-01' as order_date",
        "'paid' as financial_status",
        "'unfulfilled' as fulfillment_status",
        "'Oslo' as city",
        "cast(79 as decimal(18,4)) as order_shipping",
        "cast(order_number % 3 * 25 as decimal(18,4)) as undistributed_discount",
    )
    return headers, lines


def test_a_product_on_every_first_line_uses_all_salts(spark):
    for at in ("0", "cast(1000000 as decimal(38,0))"):
        lines = spark.range(4000).selectExpr("id as order_number", f"{at} as line_pos", "'A' as product_key")
        lookup = spark.createDataFrame([("A", 1)], "product_key string, copies long")
        joined = left_join_lookup(lines, lookup, "product_key", "order_number, line_pos", False)
        assert joined.filter("copies = 1").count() == 4000
        salts = lines.selectExpr(f"pmod(xxhash64(order_number, line_pos), {SALTS}) as s").groupBy("s").count()
        assert salts.count() == SALTS and max(r["count"] for r in salts.collect()) < 4000 / SALTS * 2
    plan = L.weigh_lines(
        lines.selectExpr("*"), sheets.cost_lookup(costs(spark, ("A", 5)), max_bytes=1)
    )._jdf.queryExecution().toString()
    assert "order_number" in plan.split("xxhash64(")[1][:40]


def test_line_sums_hash_and_do_not_sort(spark):
    from profitloom import catalog

    queries = catalog.all_queries()
    for name in ("weekly_profit", "discount_usage", "line_items", "orders_summary"):
        plan = queries[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_salted_lookup_equals_broadcast(spark, hot):
    sheet = costs(spark, ("A", 5), ("P1", 6), ("P1", 7), ("P2", None))
    small = sheets.cost_lookup(sheet)
    large = sheets.cost_lookup(sheet, max_bytes=1)
    assert small.fits and not large.fits
    same(O.order_table(*hot, CFG, small), O.order_table(*hot, CFG, large))


def test_no_broadcast_in_the_large_plan(spark, hot, capsys):
    large = sheets.cost_lookup(costs(spark, ("A", 5)), max_bytes=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        L.weigh_lines(hot[1], large).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in capsys.readouterr().out


def test_integer_sums_are_exact_where_one_long_would_overflow(spark):
    big = (1 << 62) + 12345
    frame = spark.createDataFrame([(big,), (big,), (big,), (-5,), (None,)], "u bigint")
    row = one(frame.selectExpr(f"{sum_units('u')} as s"))
    assert int(row["s"] * 10000) == 3 * big - 5
    empty = frame.filter("false").selectExpr(f"{sum_units('u')} as s")
    assert one(empty)["s"] == 0
    assert str(one(frame.filter("u < 0").selectExpr(f"{from_units('u')} as m"))["m"]) == "-0.0005"


def test_documents_and_flat_tables_give_the_same_orders(spark):
    shop = ShopTables(spark, SF_DIR)
    costs_seen = shop.cost_lookup()
    docs = L.order_headers(shop.documents(), shop.cfg)
    nested = O.order_table(
        docs.drop("line_items"), L.raw_lines(docs), shop.cfg, costs_seen, first_line=True
    )
    flat = O.order_table(shop.headers(True), shop.lines(), shop.cfg, costs_seen, first_line=True)
    same(flat, nested)


def test_documents_come_from_files_of_every_state(spark):
    shop = ShopTables(spark, SF_DIR)
    from profitloom.sources.orders import read_orders

    landed = read_orders(spark, shop.document_feed())
    newest = shop.documents()
    assert landed.count() > newest.count() == newest.select("id").distinct().count()
    assert len(landed.inputFiles()) >= 8


def test_landed_files_hold_a_bounded_number_of_pages(spark, monkeypatch):
    from profitloom.sources import tables

    feed = ShopTables(spark, SF_DIR, L.ProfitConfig(as_of=CFG.as_of, vat_rate=CFG.vat_rate)).document_feed()
    monkeypatch.setattr(tables, "FILE_PAGES", 50)
    bounded = ShopTables(spark, SF_DIR, L.ProfitConfig(as_of=CFG.as_of, discount_code_overrides={3: "x"})).document_feed()
    read = lambda path: spark.read.option("recursiveFileLookup", True).text(path)
    assert max(r["count"] for r in read(bounded).groupBy("_metadata.file_path").count().collect()) == 50
    same(read(feed), read(bounded))


def test_order_counts_read_only_order_keys(spark, capsys):
    from profitloom import catalog

    catalog.all_queries()["daily_orders"](spark, SF_DIR).explain("formatted")
    plan = capsys.readouterr().out
    # One column of the line table; products and customers are not read at all.
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "p_partkey" not in plan and "c_custkey" not in plan


@pytest.fixture
def small_pages(monkeypatch):
    from profitloom.sources import tables

    monkeypatch.setattr(tables, "PAGE_LINES", 2)


PAGED = (
    "orders_source order_fields line_items_nested incremental_orders streaming_daily_sales streaming_weekly_sales"
).split()


@pytest.mark.parametrize("name", PAGED)
def test_orders_of_several_pages_change_no_row(spark, small_pages, name):
    from compare import connect, difference

    from oracle.sql import all_sql
    from profitloom import catalog

    got = catalog.all_queries()[name](spark, SF_DIR)
    assert difference(got, connect(SF_DIR), all_sql()[name]) is None


def test_no_page_holds_more_lines_however_long_the_order(spark, small_pages, hot):
    from profitloom.sources.orders import read_orders

    class Hot(ShopTables):
        def lines(self):
            # Positions repeat and have gaps.
            odd = hot[1].selectExpr("* except (line_pos)", "cast(line_pos div 3 * 5 as decimal(38,0)) as line_pos")
            return odd.selectExpr("*", "product_key as variant_title", "1L as product_id", "cast(line_pos as long) as variant_id")

    shop = Hot(spark, SF_DIR, L.ProfitConfig(as_of=CFG.as_of, discount_code_overrides={2: "hot"}))
    pages = read_orders(spark, shop.document_feed()).filter("order_number = 7").dropDuplicates(["first_line"])
    got = pages.selectExpr("first_line", "size(line_items) as n", "line_items.variant_id as at").orderBy("first_line").collect()
    assert [(r["first_line"], r["n"]) for r in got] == [(i, 2) for i in range(0, 1000, 2)]
    assert [v for r in got for v in r["at"]] == [i // 3 * 5 for i in range(1000)]
    lines = L.line_items(shop.documents(), shop.cfg).filter("order_number = 7")
    assert lines.count() == 1000 and lines.filter("shipping_revenue > 0").count() <= 1


def test_the_text_of_a_long_order_is_made_in_pieces(spark, hot):
    from profitloom.plans import lists

    cfg, (headers, lines) = CFG, hot
    orders = O.order_table(headers, lines, cfg)
    report = lists.unfulfilled_orders(orders, lines)
    got = {r["order_number"]: r["products"] for r in report.collect()}
    want = {}
    for r in lines.orderBy("line_pos").collect():
        want.setdefault(r["order_number"], []).append(r["product_key"])
    assert got == {k: ", ".join(v) for k, v in want.items()}
    plan = report._jdf.queryExecution().toString()
    assert "rangepartitioning(order_number" in plan and "SPARK_PARTITION_ID" in plan


def test_lines_of_documents_are_dealt_once_unless_an_order_is_long(spark, monkeypatch):
    from profitloom.sources import tables

    def landed():
        names = []
        monkeypatch.setattr(tables, "new_folder", lambda s, name: names.append(name) or new_folder(s, name))
        plan = ShopTables(spark, SF_DIR)._documents()._jdf.queryExecution().executedPlan().toString()
        return names, plan

    new_folder = tables.new_folder
    names, plan = landed()
    assert "numbered-lines" not in names and "rangepartitioning" not in plan and "ShuffledHashJoin" in plan
    assert plan.count("REPARTITION_BY_NUM") == 2
    monkeypatch.setattr(tables, "PAGE_LINES", 2)
    assert "numbered-lines" in landed()[0]


def test_pages_travel_without_lines_that_nobody_asks_for(spark):
    from profitloom import catalog

    node = catalog.all_queries()["orders_source"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    columns = node.children().apply(0).output().toString()
    assert "order_number" in columns and "line_items" not in columns
