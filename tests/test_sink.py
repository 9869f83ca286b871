"""Tables on disk: what travels to be ranged."""

from profitloom.sources import sink
from profitloom.sources.tables import ShopTables


def test_lines_are_ranged_before_costs_and_amounts_join_them(spark, monkeypatch):
    from profitloom import catalog

    shop = ShopTables(spark, "/root/testdata/sf0.001")
    ranged = {}
    write = catalog.write_table
    monkeypatch.setattr(catalog, "write_table", lambda df, path, *k, **o: ranged.update({k: df}) or write(df, path, *k, **o))
    catalog.sink_tables(shop)
    rows = ranged["order_number", "line_pos"]
    assert "total_cost" not in rows.columns and rows.count() == shop.lines().count()


def test_shaped_rows_stay_in_their_task(spark, tmp_path):
    rows = spark.range(100).selectExpr("id as n", "date_add(date'2024-01-01', cast(id as int)) as order_date")
    sink.write_table(rows, str(tmp_path / "t"), "n", shape=lambda r: r.selectExpr("*", "n * 2 as twice"))
    got = sink.read_table(spark, str(tmp_path / "t"))
    assert sorted(got.collect()) == sorted(rows.selectExpr("order_date", "n", "n * 2 as twice").select(*got.columns).collect())


def test_lines_are_dealt_by_order_once_for_both_tables(spark, monkeypatch):
    """Lines meet products once; orders beyond the bound, which no bucket takes, give the same figures."""
    from profitloom import catalog

    made, lines = [], ShopTables.lines
    monkeypatch.setattr(ShopTables, "lines", lambda shop: made.append(1) or lines(shop))
    shop = ShopTables(spark, "/root/testdata/sf0.001")
    whole = sorted(catalog.sink_tables(shop).collect())
    assert made == [1]
    monkeypatch.setattr(sink, "ORDER_LINES", 4)
    assert sorted(catalog.sink_tables(shop).collect()) == whole and len(whole) > 300
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_stored_lines_meet_their_orders_without_an_exchange_of_lines(spark, tmp_path):
    from profitloom.operators import lines as L

    shop = ShopTables(spark, "/root/testdata/sf0.001")
    with sink.lines_by_order(shop.headers(), shop.lines(), shop.order_keys(), str(tmp_path), 5) as pairs:
        (headers, short), (others, rest) = pairs
        assert short.count() + rest.count() == shop.lines().count() and rest.count() > 0
        assert not set(short.select("order_number").distinct().collect()) & set(rest.select("order_number").distinct().collect())
        plan = L.allocate(headers, short)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # of headers
        assert others.count() == rest.select("order_number").distinct().count()


def test_lines_without_an_order_number_fill_no_bucket(spark, tmp_path):
    headers = spark.createDataFrame([(1,), (None,)], "order_number long")
    lines = spark.createDataFrame([(1, 10), (None, 20), (None, 30), (2, 40), (2, 50)], "order_number long, line_pos long")
    with sink.lines_by_order(headers, lines, lines, str(tmp_path), 1) as pairs:
        (_, short), (others, rest) = pairs
        assert [tuple(r) for r in short.collect()] == [(1, 10)]
        assert sorted(tuple(r) for r in rest.collect()) == [(2, 40), (2, 50)] and others.count() == 0
