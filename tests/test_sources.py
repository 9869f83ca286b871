"""Fee feeds, wallet ledger and cost sheets."""

from datetime import date
from decimal import Decimal

import pytest
from shop import CFG, by, costs, one, sheet

from profitloom.operators import orders as O
from profitloom.schemas import CARD_TRANSACTION, COST_ROW, WALLET_ENTRY
from profitloom.sources import fees, sheets


def test_card_fees_keep_charges_of_orders(spark):
    rows = [
        ("charge", 1, "2.50"),
        ("charge", 1, "1.25"),
        ("refund", 1, "9"),
        ("charge", None, "4"),
        ("charge", 0, "4"),
        ("charge", 2, None),
    ]
    got = by(fees.card_fees_by_order(spark.createDataFrame(rows, CARD_TRANSACTION)), "order_id")
    assert {k: float(v["actual_fee"]) for k, v in got.items()} == {1: 3.75, 2: 0.0}


def test_missing_feeds_are_empty(spark):
    assert fees.card_fees_by_order(fees.read_card_transactions(spark, None)).count() == 0
    start, end = fees.wallet_window(CFG)
    row = one(fees.wallet_fee_summary(fees.read_wallet_ledger(spark, None), start, end))
    assert row == {
        "total_fees": 0,
        "total_captured": 0,
        "avg_rate": 0,
        "num_transactions": 0,
    }


def test_wallet_window_covers_ninety_days_before_as_of():
    assert fees.wallet_window(CFG) == (date(2024, 6, 3), date(2024, 9, 1))


def test_wallet_summary_signs_window_and_kinds(spark):
    day = date(2024, 8, 1)
    rows = [
        (day, "capture", 10000),
        (day, "capture", -2000),
        (day, "capture-fee", -266),
        (day, "capture-fee", 34),
        (day, "payout", 99999),
        (date(2024, 6, 3), "capture", 2000),
        (date(2024, 6, 2), "capture", 77777),
        (date(2024, 9, 1), "capture-fee", -100),
        (date(2024, 9, 2), "capture-fee", -5555),
    ]
    ledger = spark.createDataFrame(rows, WALLET_ENTRY)
    row = one(fees.wallet_fee_summary(ledger, *fees.wallet_window(CFG)))
    assert (row["total_fees"], row["total_captured"], row["num_transactions"]) == (4.0, 100.0, 3)
    assert row["avg_rate"] == pytest.approx(0.04)


@pytest.mark.parametrize(("captured", "rate"), [(10000, 0.03), (0, 0.02), (-500, 0.02)])
def test_wallet_rate_falls_back(spark, captured, rate):
    day = CFG.as_of
    rows = [(day, "capture", captured), (day, "capture-fee", -300)]
    summary = fees.wallet_fee_summary(spark.createDataFrame(rows, WALLET_ENTRY), day, day)
    got = spark.range(1).withColumn("rate", O.wallet_rate(summary, CFG)).first().rate
    assert got == pytest.approx(rate)


def test_product_costs_clean_keys_and_numbers(spark):
    rows = [
        ("Jakke M", "120.50"),
        ("\u00a0 Lue \u00a0", "30"),
        ("Sko\t", "ukjent"),
        ("Votter", ""),
        ("  ", "10"),
        (None, "10"),
    ]
    names = "`Produkt navn` string, `Innkjøpspris pr. produkt i NOK uten MVA` string, x string"
    frame = spark.createDataFrame([(*r, "z") for r in rows], names)
    got = {r.product_key: r.cost_price for r in sheets.product_costs(frame).collect()}
    assert got == {"Jakke M": Decimal("120.5"), "Lue": 30, "Sko": None, "Votter": None}


def test_product_costs_fall_back_to_position(spark):
    frame = spark.createDataFrame([("A", "7", "q")], "`Produkt navn` string, Pris string, n string")
    row = sheets.product_costs(frame).collect()[0]
    assert (row.product_key, row.cost_price) == ("A", 7)


def test_fixed_costs_spellings_skips_and_last_name(spark):
    frame = sheet(
        spark,
        ("Leie", "2 000,00 kr"),
        ("Strøm", "1\u00a0266,75\u00a0kr"),
        ("Regnskap", "2.000,00"),
        ("Sum", "9 999,00 kr"),
        ("SUM ", "9 999,00 kr"),
        ("", "5"),
        (None, "5"),
        ("Tom", ""),
        ("Tomt felt", None),
        ("Leie ", "3 000,50 kr"),
        ("Rot", "mye"),
    )
    fixed = sheets.fixed_monthly_costs(frame)
    got = {r["name"]: float(r.amount) for r in fixed.collect()}
    assert got == {"Leie": 3000.5, "Strøm": 1266.75, "Regnskap": 0, "Rot": 0}
    assert float(one(sheets.total_amount(fixed))["total"]) == 4267.25


def test_per_order_sheet_splits_rules_and_amounts(spark):
    frame = sheet(
        spark,
        ("Transaksjonsgebyr Vipps", "2,99% av ordrepris"),
        ("TRANSAKSJONSGEBYR kort", "4% av ordrepris + 3 kr"),
        ("Transaksjonsgebyr kort", "5% av ordrepris + 2,50 kr"),
        ("Emballasje", "12,50"),
        ("Klistremerke", "25 kr"),
        ("Ca fraktkostnad", "49"),
        ("Ca fraktkostnad", "59"),
        ("Tom", " "),
    )
    rules = by(sheets.fee_rules(frame), "method")
    assert float(rules["vipps"]["rate"]) == 0.0299 and float(rules["vipps"]["fixed"]) == 0
    assert float(rules["kort"]["rate"]) == 0.05 and float(rules["kort"]["fixed"]) == 2.5
    got = {r["name"]: float(r.amount) for r in sheets.per_order_costs(frame).collect()}
    assert got == {"Emballasje": 12.5, "Ca fraktkostnad": 59}


@pytest.mark.parametrize(
    ("text", "rate", "fixed"),
    [("mye % + litt", 0, 0), ("7", 0, 0), ("2% + 1,5", 0.02, 1.5), ("1% + x + 4", 0.01, 0)],
)
def test_bad_fee_rules_count_as_zero(spark, text, rate, fixed):
    row = one(sheets.fee_rules(sheet(spark, ("Transaksjonsgebyr kort", text))))
    assert (float(row["rate"]), float(row["fixed"])) == (rate, fixed)


def test_empty_sheets_total_zero(spark):
    none = sheets.fixed_monthly_costs(spark.createDataFrame([], COST_ROW))
    assert float(one(sheets.total_amount(none))["total"]) == 0


def test_cost_lookup_measures_size_and_repeats(spark):
    plain = sheets.cost_lookup(costs(spark, ("A", 1), ("B", None)))
    assert plain.fits and not plain.repeats
    twice = sheets.cost_lookup(costs(spark, ("A", 1), ("A", 3), ("A", None)), max_bytes=10)
    assert not twice.fits and twice.repeats
    row = one(twice.weights)
    assert (row["copies"], row["priced"], row["cost_units"]) == (3, 2, 40000)
