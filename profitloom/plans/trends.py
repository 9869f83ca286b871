"""Reports over time, from the order table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from profitloom import config as C
from profitloom.functions.frames import grouped
from profitloom.functions.money import as_double, guarded_ratio, money_out, quote, total
from profitloom.functions.time import wall_date, wall_hour, week_start

WEEK = f"{week_start('order_date')} as week"
_WEEKDAY = f"weekday({wall_date('order_created_at')}) as weekday"
_HOUR = f"{wall_hour('order_created_at')} as hour"
_WEEKDAY_NAME = f"element_at(array({', '.join(quote(d) for d in C.WEEKDAYS)}), weekday + 1)"


def weekly_profit(orders: DataFrame) -> DataFrame:
    sums = [
        f"{money_out(total(c))} as {c}" for c in ("revenue_excl_mva", "total_cost", "profit")
    ]
    return grouped(orders, [WEEK], *sums).orderBy("week")


def overall_aov(orders: DataFrame) -> DataFrame:
    """Average order value."""
    return orders.selectExpr(
        f"{money_out(guarded_ratio(total('revenue_excl_mva'), 'count(1)'))} as aov"
    )


def weekly_aov(orders: DataFrame) -> DataFrame:
    mean = f"{as_double(total('revenue_excl_mva'))} / count(1)"
    return grouped(
        orders,
        [WEEK],
        f"{money_out(total('revenue_excl_mva'))} as revenue_excl_mva",
        "count(1) as orders",
        f"{money_out(mean)} as aov",
    ).orderBy("week")


def daily_orders(orders: DataFrame) -> DataFrame:
    """Orders per day; days without orders have no row."""
    return grouped(orders, ["order_date"], "count(1) as orders").orderBy("order_date")


def orders_per_day(orders: DataFrame) -> DataFrame:
    """Average over all calendar days of the period."""
    days = "cast(datediff(max(order_date), min(order_date)) + 1 as bigint)"
    average = f"case when {days} > 0 then count(1) / cast({days} as double) else 0d end"
    return orders.selectExpr(
        "count(1) as orders",
        f"coalesce({days}, 0L) as calendar_days",
        f"{money_out(average)} as orders_per_day",
    )


def weekday_pattern(orders: DataFrame) -> DataFrame:
    counts = grouped(orders, [_WEEKDAY], "count(1) as orders")
    return counts.selectExpr("weekday", f"{_WEEKDAY_NAME} as weekday_name", "orders").orderBy(
        "weekday"
    )


def hour_pattern(orders: DataFrame) -> DataFrame:
    """Orders per hour of the day, all 24 hours."""
    hours = orders.sparkSession.range(0, 24, 1, 1).selectExpr("cast(id as int) as hour")
    counts = grouped(orders, [_HOUR], "count(1) as orders")
    return (
        hours.join(counts, "hour", "left")
        .selectExpr(
            "hour",
            "format_string('%02d:00', hour) as hour_label",
            "coalesce(orders, 0L) as orders",
        )
        .orderBy("hour")
    )


def _busiest(slots: DataFrame, key: str) -> DataFrame:
    """Key with most orders; the smallest key among equals."""
    counts = grouped(slots, [key], "sum(orders) as orders")
    return counts.selectExpr(f"max_by({key}, struct(orders, -{key})) as {key}")


def peak_times(orders: DataFrame) -> DataFrame:
    """Weekday and hour with most orders, both from one small table of slots."""
    slots = grouped(orders, [_WEEKDAY, _HOUR], "count(1) as orders")
    return (
        _busiest(slots, "weekday")
        .selectExpr(f"{_WEEKDAY_NAME} as peak_weekday")
        .withColumn("peak_hour", _busiest(slots, "hour").scalar())
    )


def weekly_shipping(orders: DataFrame, shipping_cost: Column) -> DataFrame:
    """Shipping income and estimated cost per week, one row per week and kind."""
    weeks = grouped(
        orders, [WEEK], f"{total('shipping_revenue')} as income", "count(1) as orders"
    ).withColumn("shipping_cost", shipping_cost)
    wide = weeks.selectExpr(
        "week",
        f"{money_out('income')} as Fraktinntekter",
        f"{money_out('orders * shipping_cost')} as `Estimert fraktkostnad`",
    )
    return wide.unpivot(
        "week", ["Fraktinntekter", "Estimert fraktkostnad"], "kind", "amount"
    ).orderBy("week", "kind")
