"""Flattening, allocation, cost join and profit on hand-made documents."""

from dataclasses import replace
from decimal import Decimal

import pytest
from shop import CFG, by, costs, documents, line, order

from profitloom.operators import lines as L


def table(spark, *docs):
    return L.line_items(documents(spark, *docs), CFG)


def test_order_fields_and_defaults(spark):
    rows = by(
        table(
            spark,
            order(1, [line("Jakke", "M")]),
            order(
                2,
                [line("Lue")],
                fulfillment_status=None,
                financial_status=...,
                email=None,
                payment_gateway_names=[],
                shipping_address=None,
                billing_address={"city": "Bergen"},
                discount_codes=[{"code": "SOMMER"}, {"code": "B"}],
            ),
            order(3, [line("Lue", "")], shipping_address={"city": ""}, fulfillment_status=""),
        ),
        "order_number",
    )
    assert rows[1]["product_key"] == "Jakke M" and rows[2]["product_key"] == "Lue"
    assert rows[3]["product_key"] == "Lue"
    assert rows[1]["order_id"] == 5001 and str(rows[1]["order_date"]) == "2024-07-01"
    assert rows[1]["discount_code"] == "Ingen rabatt" and rows[2]["discount_code"] == "SOMMER"
    assert rows[2]["fulfillment_status"] == rows[3]["fulfillment_status"] == "unfulfilled"
    assert rows[2]["financial_status"] == "" and rows[2]["customer_email"] is None
    assert rows[2]["payment_method"] == "Ukjent" and rows[1]["payment_method"] == "shopify_payments"
    assert [rows[i]["city"] for i in (1, 2, 3)] == ["Oslo", "Bergen", "Ukjent"]


def test_code_override_beats_the_orders_own_code(spark):
    docs = documents(
        spark,
        order(1019, [line("A")], discount_codes=[{"code": "X"}]),
        order(1020, [line("A")], discount_codes=[{"code": "Y"}]),
    )
    cfg = replace(CFG, discount_code_overrides={1019: "KIRA30", 7: "Z"})
    for limit in (1 << 20, 0):
        headers = L.with_overrides(L.order_headers(docs, CFG), L.override_table(spark, cfg), limit)
        assert {r.order_number: r.discount_code for r in headers.collect()} == {1019: "KIRA30", 1020: "Y"}
    assert {r.discount_code for r in L.line_items(docs, cfg).collect()} == {"KIRA30", "Y"}
    assert {r.discount_code for r in L.line_items(docs, CFG).collect()} == {"X", "Y"}


def test_key_is_not_stripped_on_the_line_side(spark):
    assert table(spark, order(1, [line(" A ")])).collect()[0].product_key == " A "


def test_orders_without_lines_give_no_rows(spark):
    docs = [
        order(1, [line("A")], shipping_lines=[{"price": "79"}]),
        order(2, [], shipping_lines=[{"price": "99"}]),
        order(3, ..., shipping_lines=[{"price": "99"}]),
    ]
    rows = table(spark, *docs).collect()
    assert [(r.order_number, r.shipping_revenue) for r in rows] == [(1, Decimal(79))]


@pytest.mark.parametrize(
    ("order_discount", "shares"),
    [("60", [20, 40]), ("30", [0, 0]), ("10", [0, 0]), ("90", [40, 80])],
)
def test_left_over_discount_is_shared_by_value(spark, order_discount, shares):
    # Two lines of 100 and 200 with 30 already given on the first.
    factor = {"60": 10, "30": 0, "10": 0, "90": 20}[order_discount]
    lines = [line("A", discount="30"), line("B", quantity=2)]
    rows = table(spark, order(1, lines, total_discounts=order_discount)).collect()
    got = [float(r.order_discount_share) for r in sorted(rows, key=lambda r: r.line_pos)]
    assert got == pytest.approx([factor * 1.0, factor * 2.0], abs=1e-9)
    assert got == pytest.approx([s / 2 for s in shares], abs=1e-9)
    assert sum(got) == pytest.approx(max(0, float(order_discount) - 30), abs=1e-9)


def test_free_items_take_no_discount(spark):
    rows = table(spark, order(1, [line("A", price="0")], total_discounts="50")).collect()
    assert rows[0].order_discount_share == 0


def test_shares_that_do_not_terminate(spark):
    rows = table(spark, order(1, [line("A"), line("B"), line("C")], total_discounts="50")).collect()
    assert [r.order_discount_share for r in rows] == [Decimal("16.666666667")] * 3


def test_shipping_sits_on_the_first_line(spark):
    lines = [line("A"), line("B")]
    rows = table(
        spark, order(1, lines, shipping_lines=[{"price": "79"}, {"price": "20.50"}])
    ).collect()
    assert {r.line_pos: float(r.shipping_revenue) for r in rows} == {0: 99.5, 1: 0.0}


def enriched(spark, sheet, *docs, **kwargs):
    return L.enriched_lines(table(spark, *docs), costs(spark, *sheet), CFG, **kwargs)


def test_revenue_vat_cost_and_margin(spark):
    doc = order(
        1,
        [line("A", quantity=2, price="125", discount="25")],
        shipping_lines=[{"price": "50"}],
    )
    row = enriched(spark, [("A", 60)], doc).collect()[0].asDict()
    want = {
        "item_revenue": 225,
        "revenue": 275,
        "revenue_excl_mva": 220,
        "mva_collected": 55,
        "shipping_revenue_excl_mva": 40,
        "total_cost": 120,
        "profit": 100,
        "margin_pct": 45.5,
    }
    assert {k: float(row[k]) for k in want} == want
    assert row["is_refunded"] is False


def test_margin_rounds_half_to_even_and_survives_zero_revenue(spark):
    # Net 800 with profit 2 is 0.25 %.
    rows = by(
        enriched(
            spark,
            [("A", 798), ("B", 5)],
            order(1, [line("A", price="1000")]),
            order(2, [line("B", price="0")]),
        ),
        "product_key",
    )
    assert rows["A"]["margin_pct"] == 0.2
    assert rows["B"]["margin_pct"] is None and float(rows["B"]["profit"]) == -5


def test_line_without_cost_keeps_revenue_but_no_profit(spark):
    row = enriched(spark, [("other", 1)], order(1, [line("A")])).collect()[0]
    assert row.cost_price is None and row.profit is None and float(row.revenue_excl_mva) == 80


def test_repeated_cost_key_repeats_lines_unless_deduped(spark):
    sheet = [("A", 10), ("A", 20)]
    docs = [order(1, [line("A")]), order(2, [line("A")])]
    assert enriched(spark, sheet, *docs).count() == 4
    rows = enriched(spark, sheet, *docs, dedupe_costs=True).collect()
    assert [float(r.cost_price) for r in rows] == [10, 10]


def test_only_listed_statuses_are_refunded(spark):
    docs = [
        order(n, [line("A")], financial_status=status)
        for n, status in enumerate(["refunded", "partially_refunded", "voided", "pending"])
    ]
    kept = L.active(enriched(spark, [("A", 1)], *docs), CFG).collect()
    assert {r.financial_status for r in kept} == {"partially_refunded", "voided", "pending"}


def test_flat_and_nested_inputs_agree(spark):
    docs = documents(
        spark,
        *[
            order(
                n,
                [line("A", price="33.33"), line("B", quantity=n % 4, price="7"), line("A")],
                total_discounts=str(n * 5),
                shipping_lines=[{"price": "79"}] if n % 2 else [],
            )
            for n in range(1, 30)
        ],
    )
    headers = L.order_headers(docs, CFG)
    flat = L.line_table(L.allocate(headers.drop("line_items"), L.raw_lines(headers)))
    nested = L.line_items(docs, CFG).select(*flat.columns)
    assert flat.exceptAll(nested).count() == nested.exceptAll(flat).count() == 0
    assert flat.count() == 87


def test_flattening_needs_no_shuffle(spark, capsys):
    table(spark, order(1, [line("A")])).explain()
    assert "Exchange" not in capsys.readouterr().out
