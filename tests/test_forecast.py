"""Forecasts from day sums against the batch forecast over the orders known by then."""

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest

from profitloom.plans import forecast, pnl
from profitloom.storage import new_folder
from shop import CFG

ORDERS = "order_number long, order_date date, is_refunded boolean, revenue_excl_mva decimal(26,10), total_cost decimal(26,10), txn_fee decimal(26,10)"
NAMED = "name string, amount decimal(18,4)"
FIRST = [
    (1, date(2022, 12, 30), False, 100, 40, 3), (2, date(2023, 1, 5), False, 200, 90, 5), (3, date(2023, 1, 5), True, 70, 20, 2),
    (4, date(2023, 3, 1), False, 50, 60, 1), (5, date(2024, 2, 29), False, 10, 4, 0), (6, None, False, 9, 9, 9), (7, date(2024, 5, 1), False, 0, 0, 0),
]
# Order 2 is refunded, 4 moves to another day, 8 is new and early, 5 costs more.
SECOND = [
    (1, date(2022, 12, 30), False, 100, 40, 3), (2, date(2023, 1, 5), True, 200, 90, 5), (3, date(2023, 1, 5), True, 70, 20, 2),
    (4, date(2023, 2, 1), False, 50, 60, 1), (5, date(2024, 2, 29), False, 10, 6, 0), (6, None, False, 9, 9, 9), (7, date(2024, 5, 1), False, 0, 0, 0),
    (8, date(2022, 1, 1), False, 33, 11, 2),
]


def table(spark, rows):
    return spark.createDataFrame([(n, d, r, *map(Decimal, m)) for n, d, r, *m in rows], ORDERS)


@pytest.fixture(scope="module")
def costs(spark):
    return [spark.createDataFrame([("a", Decimal(12)), ("b", Decimal(30))], NAMED), spark.createDataFrame([("c", Decimal("1.5"))], NAMED)]


def batch(spark, rows, costs, day):
    known = [r for r in rows if r[1] is not None and r[1] <= day]
    return pnl.forecast_figures(pnl.year_forecast(table(spark, known), *costs, replace(CFG, as_of=day))).collect()


def test_any_day_equals_batch_after_every_booking(spark, costs):
    sums = forecast.DaySums(spark, new_folder(spark, "days"))
    first, second = table(spark, FIRST), table(spark, SECOND)
    for booking, (changes, rows) in enumerate([(forecast.day_sums(first), FIRST), (forecast.day_changes(first, second), SECOND)]):
        sums.book(changes, booking)
        sums.book(changes, booking)
        asked = [date(2022, 1, 1), date(2022, 12, 31), date(2023, 1, 4), date(2023, 1, 5), date(2023, 2, 1), date(2023, 12, 31), date(2024, 2, 28),
                 date(2024, 2, 29), date(2024, 12, 31), date(2025, 1, 1), date(2022, 1, 1)]
        got = forecast.forecast_by_day(sums.days(), *costs, spark.createDataFrame([(d,) for d in asked], "d date")).collect()
        want = [(d, *tuple(r)) for d in sorted(set(asked)) for r in batch(spark, rows, costs, d)]
        assert sorted(tuple(r) for r in got) == want


def test_a_change_books_only_its_days(spark):
    changes = forecast.day_changes(table(spark, FIRST), table(spark, SECOND)).collect()
    assert sorted(r["order_date"] for r in changes) == [date(2022, 1, 1), date(2023, 1, 5), date(2023, 2, 1), date(2023, 3, 1), date(2024, 2, 29)]


def test_without_orders_there_is_no_row(spark, costs):
    assert forecast.forecast_by_day(forecast.day_sums(table(spark, [])), *costs).count() == 0
