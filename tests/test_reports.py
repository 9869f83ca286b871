"""Order table, fees and reports on a hand-made shop."""

from datetime import date
from decimal import Decimal

import pytest
from shop import CFG, by, costs, documents, line, one, order, sheet

from profitloom.config import ProfitConfig
from profitloom.functions.money import AMOUNT
from profitloom.operators import lines as L
from profitloom.operators import orders as O
from profitloom.plans import checks, customers, discounts, lists, pnl, products, records, trends
from profitloom.schemas import CARD_TRANSACTION, WALLET_ENTRY
from profitloom.sources import fees, sheets

DOCS = [
    order(
        1,
        [line("A", quantity=2, price="125"), line("B", price="50")],
        created="2024-07-01T23:30:00+02:00",
        shipping_lines=[{"price": "50"}],
        discount_codes=[{"code": "SOMMER"}],
        total_discounts="30",
        email="x@example.org",
    ),
    order(
        2,
        [line("C", price="200")],
        created="2024-07-08T00:10:00+02:00",
        payment_gateway_names=["Vipps/MobilePay Payments"],
        email="x@example.org",
        fulfillment_status=None,
    ),
    order(3, [line("A", price="999")], financial_status="refunded", fulfillment_status=None),
    order(
        4,
        [line("B", price="100", discount="10"), line("A", price="125"), line("C", price="5")],
        created="2024-11-04T09:00:00+01:00",
        discount_codes=[{"code": "HØST"}],
        total_discounts="10",
        email="",
        fulfillment_status="",
        shipping_address=None,
    ),
    order(5, []),
]
SHEET = [("A", 60), ("B", 20)]


@pytest.fixture(scope="module")
def shop(spark):
    docs = documents(spark, *DOCS)
    headers = L.order_headers(docs, CFG).drop("line_items")
    raw = L.raw_lines(L.order_headers(docs, CFG))
    return docs, headers, raw


def table(spark, shop, cost_rows=SHEET, **kwargs):
    _, headers, raw = shop
    lookup = sheets.cost_lookup(costs(spark, *cost_rows))
    return O.order_table(headers, raw, CFG, lookup, **kwargs)


def line_table(spark, shop, cost_rows=SHEET):
    return L.enriched_lines(L.line_items(shop[0], CFG), costs(spark, *cost_rows), CFG)


def test_order_table_figures(spark, shop):
    rows = by(table(spark, shop, first_line=True), "order_number")
    assert set(rows) == {1, 2, 3, 4}
    first = {k: float(rows[1][k]) for k in ("revenue", "total_discount", "total_cost", "profit")}
    # 250 + 50 - 30 + 50 = 320; net 256; costs 2*60 + 20.
    assert first == {"revenue": 320, "total_discount": 30, "total_cost": 140, "profit": 116}
    assert float(rows[1]["first_line_discount"]) == 25  # 30 * 250 / 300
    # C has no cost: it counts in revenue, not in profit.
    assert float(rows[2]["revenue"]) == 200 and float(rows[2]["profit"]) == 0
    assert rows[2]["unpriced_lines"] == 1 and rows[4]["unpriced_lines"] == 1
    assert float(rows[4]["revenue"]) == 220
    assert float(rows[4]["profit"]) == pytest.approx((90 + 125) * 0.8 - 80)


@pytest.mark.parametrize("cost_rows", [SHEET, [*SHEET, ("A", 10), ("B", None), ("C", 1)]])
def test_order_table_equals_sums_over_lines(spark, shop, cost_rows):
    """Also when the cost sheet repeats keys, so that merged lines are repeated."""
    got = by(table(spark, shop, cost_rows, first_line=True), "order_number")
    lines = line_table(spark, shop, cost_rows)
    want = by(O.order_totals(lines), "order_number")
    level = by(O.order_level(lines, CFG), "order_number")
    counts = by(lines.groupBy("order_number").count(), "order_number")
    profit = by(lines.groupBy("order_number").agg({"profit": "sum"}), "order_number")
    assert set(got) == set(want)
    for number, row in got.items():
        for name in ("revenue_excl_mva", "total_cost", "total_discount", "shipping_revenue"):
            assert float(row[name]) == pytest.approx(float(want[number][name]), abs=1e-7)
        assert float(row["profit"]) == pytest.approx(
            float(profit[number]["sum(profit)"] or 0), abs=1e-7
        )
        assert float(row["revenue"]) == pytest.approx(float(level[number]["revenue"]), abs=1e-7)
        assert row["n_lines"] == counts[number]["count"]
        assert row["order_date"] == want[number]["order_date"]


def test_order_totals_take_the_first_present_value(spark, shop):
    lines = line_table(spark, shop).filter("order_number = 4")
    changed = lines.selectExpr(
        "* except (discount_code)", "if(line_pos = 0, null, concat('c', line_pos)) as discount_code"
    )
    assert O.order_totals(changed).collect()[0].discount_code == "c1"


def with_fees(spark, orders, rules=(("Transaksjonsgebyr kort", "5% + 2"),)):
    txns = spark.createDataFrame([("charge", 5001, "7.25")], CARD_TRANSACTION)
    ledger = spark.createDataFrame(
        [(CFG.as_of, "capture", 10000), (CFG.as_of, "capture-fee", -250)], WALLET_ENTRY
    )
    wallet = fees.wallet_fee_summary(ledger, CFG.as_of, CFG.as_of)
    rule_table = sheets.fee_rules(sheet(spark, *rules))
    return O.with_txn_fee(orders, fees.card_fees_by_order(txns), wallet, rule_table, CFG), wallet


def test_three_way_fee_rule(spark, shop):
    rows = by(with_fees(spark, table(spark, shop))[0], "order_number")
    assert float(rows[1]["txn_fee"]) == 7.25  # charged
    assert float(rows[2]["txn_fee"]) == pytest.approx(160 * 0.025)  # wallet rate
    assert float(rows[4]["txn_fee"]) == pytest.approx(176 * 0.05 + 2)  # card rule
    no_rule = by(with_fees(spark, table(spark, shop), (("Frakt", "1"),))[0], "order_number")
    assert float(no_rule[4]["txn_fee"]) == 0


def result(spark, shop):
    orders = with_fees(spark, table(spark, shop))[0]
    fixed = sheets.fixed_monthly_costs(sheet(spark, ("Leie", "100 kr"), ("Strøm", "20")))
    per_order = sheets.per_order_costs(sheet(spark, ("Eske", "3"), ("Ca fraktkostnad", "10")))
    return orders, fixed, per_order


def test_net_result_adds_up(spark, shop):
    orders, fixed, per_order = result(spark, shop)
    row = one(pnl.net_result(pnl.profit_and_loss(orders, fixed, per_order)))
    net_sales = 256 + 160 + 176
    gross = net_sales - (140 + 80)
    fee = 7.25 + 4 + 10.8
    overhead = 120 * (126 / 30)
    assert row["gross_profit"] == gross
    assert row["total_txn_fees"] == pytest.approx(fee)
    assert row["total_per_order_costs"] == pytest.approx(fee + 39)
    assert row["total_fixed_overhead"] == pytest.approx(overhead)
    assert row["net_profit"] == pytest.approx(gross - fee - 39 - overhead)
    assert row["net_margin_pct"] == pytest.approx(row["net_profit"] / net_sales * 100, abs=1e-5)


def test_statement_lines_add_up(spark, shop):
    rows = pnl.pnl_statement(pnl.profit_and_loss(*result(spark, shop)), CFG).orderBy("line_no").collect()
    amounts = [r.amount for r in rows]
    assert [r.line_no for r in rows] == list(range(1, 13))
    assert sum(amounts[:3]) == pytest.approx(amounts[3])
    assert amounts[3] + amounts[4] == pytest.approx(amounts[5])
    assert amounts[5] + amounts[6] == pytest.approx(amounts[7])
    assert sum(amounts[7:11]) == pytest.approx(amounts[11])


def test_short_periods_count_as_one_month(spark, shop):
    orders = table(spark, shop).filter("order_number in (1, 2)")
    fixed = sheets.fixed_monthly_costs(sheet(spark, ("Leie", "100")))
    row = one(pnl.overhead_for_period(orders, fixed))
    assert row == {"months_covered": 1, "monthly_overhead": 100, "total_overhead": 100}


def test_fee_breakdown_shows_the_wallet_rate_for_estimates(spark, shop):
    orders, wallet = with_fees(spark, L.active(table(spark, shop), CFG))
    rows = by(pnl.fee_breakdown(orders, O.wallet_rate(wallet, CFG)), "fee_source")
    assert rows["actual"]["shown_rate_pct"] == rows["actual"]["measured_rate_pct"]
    assert rows["estimated"]["shown_rate_pct"] == 2.5
    assert rows["estimated"]["orders"] == 2


def test_cost_tables_have_a_total_row(spark, shop):
    orders, fixed, per_order = result(spark, shop)
    rows = by(pnl.fixed_cost_table(fixed), "cost_name")
    assert rows["Totalt (månedlig)"]["amount"] == 120 and rows["Totalt (månedlig)"]["is_total"] == 1
    rows = by(pnl.order_cost_table(per_order, orders), "cost_name")
    assert rows["Sum pr. bestilling"]["amount_all_orders"] == 39


def test_forecast_uses_the_year_of_as_of(spark, shop):
    orders, fixed, per_order = result(spark, shop)
    row = one(pnl.forecast_figures(pnl.year_forecast(orders, fixed, per_order, CFG)))
    assert row["days_with_data"] == 127 and str(row["first_order_date"]) == "2024-07-01"
    assert row["projected_revenue"] == pytest.approx(592 / 127 * 366, abs=0.01)
    other = ProfitConfig(as_of=date(2023, 5, 1))
    assert pnl.year_forecast(orders, fixed, per_order, other).count() == 0


def test_break_even_guards_negative_contribution(spark, shop):
    orders, fixed, per_order = result(spark, shop)
    row = one(pnl.break_even(pnl.profit_and_loss(orders, fixed, per_order)))
    assert row["break_even_orders"] == pytest.approx(
        120 / row["contribution_per_order"], abs=0.01
    )
    dear = sheets.per_order_costs(sheet(spark, ("Gull", "9999")))
    row = one(pnl.break_even(pnl.profit_and_loss(orders, fixed, dear)))
    assert row["contribution_per_order"] < 0 and row["break_even_orders"] == 0


def test_reports_on_no_orders(spark, shop):
    orders, fixed, per_order = result(spark, shop)
    none = orders.filter("order_number < 0")
    row = one(pnl.net_result(pnl.profit_and_loss(none, fixed, per_order)))
    assert row["net_profit"] == -120 and row["net_margin_pct"] == 0
    assert one(trends.orders_per_day(none))["orders_per_day"] == 0
    assert one(trends.overall_aov(none))["aov"] == 0
    assert one(customers.repeat_customers(none))["repeat_rate_pct"] == 0
    assert customers.order_frequency(none).count() == 3
    assert records.best_customer(none).count() == records.biggest_order(none).count() == 0
    assert one(discounts.discount_baseline(none))["baseline_aov"] == 0


def test_price_scenario(spark):
    product = spark.createDataFrame(
        [("A", Decimal(40), Decimal(125)), ("B", Decimal(1), Decimal(0))],
        "product_key string, cost_price decimal(18,4), sell_price decimal(18,4)",
    )
    rows = pnl.price_scenario(product, [Decimal(1), Decimal("2")], CFG).collect()
    assert {(r.product_key, r.price_factor) for r in rows} == {("A", 1.0), ("A", 2.0)}
    row = next(r for r in rows if r.price_factor == 1)
    assert (row.sell_price_excl_mva, row.mva, row.gross_profit, row.margin_pct) == (100, 25, 60, 60)
    assert (row.net_after_wallet_fee, row.net_after_card_fee) == (58, 53)


def test_weeks_start_on_monday_and_hours_follow_the_shop_clock(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    weeks = [str(r.week) for r in trends.weekly_profit(orders).collect()]
    assert weeks == ["2024-07-01", "2024-07-08", "2024-11-04"]
    hours = {r.hour: r.orders for r in trends.hour_pattern(orders).collect()}
    assert len(hours) == 24 and {h for h, n in hours.items() if n} == {23, 0, 9}
    days = [(r.weekday, r.weekday_name, r.orders) for r in trends.weekday_pattern(orders).collect()]
    assert days == [(0, "Mandag", 3)]
    assert one(trends.peak_times(orders)) == {"peak_weekday": "Mandag", "peak_hour": 0}


def test_daily_average_counts_empty_days(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    assert trends.daily_orders(orders).count() == 3
    row = one(trends.orders_per_day(orders))
    assert row["calendar_days"] == 127 and row["orders_per_day"] == 0.02


def sums(spark, shop, cost_rows=SHEET):
    lines = L.active(L.allocate_documents(shop[0], CFG), CFG)
    return products.product_sums(lines, sheets.cost_lookup(costs(spark, *cost_rows)), CFG)


def test_product_reports(spark, shop):
    titles = products.by_title(sums(spark, shop))
    margin = by(products.product_margin(titles), "product_title")
    assert set(margin) == {"A", "B"}
    best = one(products.best_product(titles))
    assert best["quantity_product"] == "A" and best["quantity"] == 3
    missing = products.unmatched_products(sums(spark, shop)).collect()
    assert [(r.product_key, r.quantity, r.revenue_excl_mva) for r in missing] == [("C", 2, 164)]
    assert one(products.unmatched_headline(sums(spark, shop))) == {"products": 1, "n_lines": 2}


def test_product_reports_with_repeated_costs_equal_merged_lines(spark, shop):
    rows = [*SHEET, ("A", 10), ("C", None), ("C", None)]
    merged = L.active(line_table(spark, shop, rows), CFG)
    want = {
        r.product_title: r
        for r in merged.groupBy("product_title")
        .agg({"profit": "sum", "revenue_excl_mva": "sum", "quantity": "sum"})
        .collect()
    }
    titles = products.by_title(sums(spark, shop, rows))
    for r in products.top_products_profit(titles, CFG).collect():
        expected = want[r.product_title]
        assert r.profit == pytest.approx(float(expected["sum(profit)"] or 0), abs=0.01)
        assert r.revenue_excl_mva == pytest.approx(float(expected["sum(revenue_excl_mva)"]), abs=0.01)
        assert r.quantity == expected["sum(quantity)"]


def test_ties_at_the_cut_fall_to_the_smaller_name(spark):
    rows = [(f"p{n:02d}", Decimal(5 if n < 14 else 1)) for n in range(20)]
    titles = spark.createDataFrame(
        rows, f"product_title string, profit {AMOUNT}"
    ).selectExpr("*", "profit as sales", "1L as units")
    got = [r.product_title for r in products.top_products_profit(titles, CFG).collect()]
    assert got == [f"p{n:02d}" for n in range(15)]


def test_customers_need_an_email(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    row = one(customers.repeat_customers(orders))
    assert row == {"unique_customers": 1, "repeat_customers": 1, "repeat_rate_pct": 100.0}
    buckets = {r.order_frequency: r.customers for r in customers.order_frequency(orders).collect()}
    assert buckets == {"1 bestilling": 0, "2 bestillinger": 1, "3+ bestillinger": 0}
    best = one(records.best_customer(orders))
    assert (best["customer_email"], best["orders"]) == ("x@example.org", 2)


def test_payment_names_and_cities(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    assert set(by(customers.payment_summary(orders), "payment_method")) == {
        "Kort (Shopify Payments)",
        "Vipps",
    }
    cities = by(customers.city_top(orders, CFG), "city")
    assert cities["Oslo"]["orders"] == 2 and cities["Ukjent"]["orders"] == 1


def test_discount_reports(spark, shop):
    orders = L.active(table(spark, shop, first_line=True), CFG)
    usage = by(discounts.discount_usage(orders), "discount_code")
    assert usage["SOMMER"]["first_line_discount"] == 25
    assert usage["SOMMER"]["all_line_discount"] == 30
    rows = by(discounts.discount_profitability(orders), "discount_code")
    assert set(rows) == {"SOMMER", "HØST"}
    assert rows["SOMMER"]["baseline_aov"] == 160
    assert rows["SOMMER"]["verdict"] == "Høyere ordreverdi"


def test_code_without_discount_counts_as_plain(spark):
    docs = documents(
        spark,
        order(1, [line("A")], discount_codes=[{"code": "FRI"}]),
        order(2, [line("A", price="300")]),
    )
    headers = L.order_headers(docs, CFG)
    orders = O.order_table(headers.drop("line_items"), L.raw_lines(headers), CFG)
    assert one(discounts.discount_baseline(orders))["baseline_aov"] == 160
    assert discounts.discount_profitability(orders).count() == 0


def test_shipping_cost_defaults_to_zero(spark, shop):
    orders, _, per_order = result(spark, shop)
    kept = L.active(orders, CFG)
    row = one(discounts.shipping_result(kept, discounts.shipping_cost_per_order(per_order)))
    assert row == {
        "shipping_revenue": 50,
        "estimated_shipping_cost": 30,
        "shipping_result": 20,
    }
    none = discounts.shipping_cost_per_order(per_order.filter("name = 'Eske'"))
    assert one(discounts.shipping_result(kept, none))["shipping_result"] == 50


def test_records_prefer_the_smaller_key(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    day = one(records.best_day(orders))
    assert str(day["revenue_day"]) == str(day["orders_day"]) == "2024-07-01"
    assert one(records.biggest_order(orders))["order_number"] == 1
    week = one(records.best_week(orders))
    assert str(week["profit_week"]) == "2024-07-01" and week["profit"] == 116


def test_open_orders_list_every_product(spark, shop):
    orders = L.active(table(spark, shop), CFG)
    assert one(lists.unfulfilled_count(orders))["open_orders"] == 2
    rows = lists.unfulfilled_orders(orders, shop[2]).collect()
    assert [(r.order_number, r.products) for r in rows] == [(4, "B, A, C"), (2, "C")]
    twice = sheets.cost_lookup(costs(spark, ("A", 1), ("A", 2), ("C", None), ("C", 3), ("C", 4)))
    rows = lists.unfulfilled_orders(orders, shop[2], twice).collect()
    assert [(r.order_number, r.products) for r in rows] == [(4, "B, A, A, C, C, C"), (2, "C, C, C")]


def test_fee_breakdown_always_has_both_rows(spark, shop):
    orders, wallet = with_fees(spark, table(spark, shop))
    for kept, empty in (("actual_fee is not null", "estimated"), ("false", "actual")):
        rows = by(pnl.fee_breakdown(orders.filter(kept), O.wallet_rate(wallet, CFG)), "fee_source")
        assert set(rows) == {"actual", "estimated"}
        assert (rows[empty]["orders"], rows[empty]["fees"], rows[empty]["measured_rate_pct"]) == (0, 0, 0)


def test_statement_names_the_vat_rate(spark, shop):
    cfg = ProfitConfig(as_of=CFG.as_of, vat_rate=Decimal("0.125"))
    names = [r.post for r in pnl.pnl_statement(pnl.profit_and_loss(*result(spark, shop)), cfg).collect()]
    assert "MVA til staten (12.5%)" in names


def test_average_order_value_times_orders_is_headline_revenue(spark):
    from profitloom import catalog

    row = {n: one(catalog.all_queries()[n](spark, "/root/testdata/sf0.001")) for n in ("overall_aov", "headline_totals")}
    total = row["headline_totals"]
    assert row["overall_aov"]["aov"] * total["num_orders"] == pytest.approx(total["revenue_excl_mva"], abs=0.01 * total["num_orders"])
    assert catalog.all_queries()["duplicate_cost_keys"](spark, "/root/testdata/sf0.001").count() > 0


def test_order_and_line_lists(spark, shop):
    numbers = [r.order_number for r in lists.orders_summary(L.active(table(spark, shop), CFG)).collect()]
    assert numbers == [4, 2, 1]
    rows = lists.line_detail(L.active(line_table(spark, shop), CFG)).collect()
    assert [(r.order_number, r.product_key) for r in rows] == [
        (4, "B"), (4, "A"), (4, "C"), (2, "C"), (1, "A"), (1, "B"),
    ]


def test_checks(spark, shop):
    orders = table(spark, shop)
    row = one(checks.cost_coverage(L.active(orders, CFG)))
    assert (row["n_lines"], row["priced_lines"]) == (6, 4)
    for row in checks.reconciliation(orders).collect():
        assert row.difference == 0 and row.left_side == row.right_side
    repeated = checks.duplicate_cost_keys(costs(spark, ("A", 1), ("A", 2), ("B", 1)))
    assert one(repeated) == {"product_key": "A", "listings": 2}
    row = one(checks.allocation_check(L.allocate_documents(shop[0], CFG), shop[1]))
    assert row == {"orders": 4, "orders_with_share_gap": 0, "orders_with_shipping_gap": 0}


def test_another_vat_rate(spark, shop):
    cfg = ProfitConfig(as_of=CFG.as_of, vat_rate=Decimal("0.15"))
    row = O.order_table(shop[1], shop[2], cfg).filter("order_number = 2").collect()[0]
    assert float(row.revenue_excl_mva) == pytest.approx(200 / 1.15, abs=1e-9)
    assert row.revenue == row.revenue_excl_mva + row.mva_collected
