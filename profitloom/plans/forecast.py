"""The year's forecast as of any day, from sums by day kept up to date by differences (K9).

``DaySums`` holds a row of sums per day and booked change; a change of orders (new, moved to another
day, refunded) is booked as what it adds to each day and takes from it, so a booking costs what it
changes. ``forecast_by_day`` answers every day at once: within a year sums run from 1 January on, each
day adding its own and the turn of the year dropping all; fees go by the rate of all days so far.
There is one row per day and change before a sum, one row per day after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profitloom.functions.frames import grouped
from profitloom.functions.money import AMOUNT, as_double, cast, guarded_ratio, money_out, total
from profitloom.sources.sheets import total_amount

SUMS = ("revenue_excl_mva", "total_cost", "txn_fee")
SCHEMA = "order_date date, orders bigint, " + ", ".join(f"{c} {AMOUNT}" for c in SUMS)


def day_sums(orders: DataFrame) -> DataFrame:
    """Order count and exact sums by day over orders that were not refunded; rows without a day count nowhere."""
    rows = orders.filter("not is_refunded and order_date is not null")
    return grouped(rows, ["order_date"], "count(1) as orders", *[f"{cast(total(c), AMOUNT)} as {c}" for c in SUMS])


def _merged(days: DataFrame) -> DataFrame:
    sums = [f"{cast(total(c), AMOUNT)} as {c}" for c in SUMS]
    return grouped(days, ["order_date"], f"{total('orders')} as orders", *sums)


def day_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What replacing the orders ``before`` by ``after`` adds to each day; days without a change are left out."""
    old = day_sums(before).selectExpr("order_date", "-orders as orders", *[f"{cast(f'-{c}', AMOUNT)} as {c}" for c in SUMS])
    changed = " or ".join(f"{c} <> 0" for c in ("orders", *SUMS))
    return _merged(day_sums(after).unionByName(old)).filter(changed)


class DaySums:
    """Sums by day in a folder, one sub-folder a booking. A booking that is run again replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def book(self, changes: DataFrame, booking: int) -> None:
        """Add the sums of ``day_sums`` or ``day_changes`` under a number of its own."""
        rows = changes.select("order_date", "orders", *SUMS)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/booking={booking}")

    def days(self) -> DataFrame:
        """One row per day that has orders."""
        booked = self.spark.read.schema(SCHEMA + ", booking bigint").option("basePath", self.folder).parquet(self.folder)
        return _merged(booked.drop("booking")).filter("orders <> 0")


def forecast_by_day(days: DataFrame, fixed: DataFrame, per_order: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """A row per day: the forecast of its year as ``year_forecast`` gives it over the orders up to that day.

    Without ``as_of`` (one column of days) every day with orders is answered. Days before the first
    order of their year have no row; a day asked twice is answered once.
    """
    zeros = [f"{cast('0', AMOUNT)} as {c}" for c in SUMS]
    known = days.selectExpr("order_date", "cast(orders as bigint) as orders", *SUMS)
    asked = known.select("order_date")
    if as_of is not None:
        asked = as_of.toDF("order_date").filter("order_date is not null").distinct()
    # Days that are only asked for add nothing.
    empty = asked.join(known, "order_date", "left_anti").selectExpr("order_date", "0L as orders", *zeros)
    rows = known.unionByName(empty).withColumn("year", F.year("order_date"))

    # A year has at most 366 rows, and the table of years a row per year.
    so_far = Window.partitionBy("year").orderBy("order_date").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    spent = ("revenue_excl_mva", "txn_fee")
    years = grouped(rows, ["year"], *[f"sum({c}) as {c}" for c in spent])
    years = years.select("year", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in spent])
    has_orders = "if(orders <> 0, order_date, null)"
    running = rows.select(
        F.col("order_date").alias("as_of"),
        "year",
        F.expr(f"min({has_orders})").over(so_far).alias("first_order_date"),
        F.expr(f"max({has_orders})").over(so_far).alias("last_order_date"),
        F.sum("orders").over(so_far).alias("year_orders"),
        *[F.sum(c).over(so_far).alias(f"year_{c}") for c in SUMS],
    )
    sheet = total_amount(fixed).selectExpr("cast(total as double) as monthly_overhead")
    each = total_amount(per_order).selectExpr("cast(total as double) as cost_per_order")
    found = running.join(years, "year").join(asked.toDF("as_of"), "as_of", "left_semi").filter("year_orders > 0")
    found = found.withColumns({"monthly_overhead": sheet.scalar(), "cost_per_order": each.scalar()})
    length = "cast(datediff(make_date(year, 12, 31), make_date(year, 1, 1)) + 1 as double)"
    figures = found.selectExpr(
        "*",
        "cast(datediff(last_order_date, first_order_date) + 1 as bigint) as days_with_data",
        f"{length} as days_in_year",
        f"{as_double('before_txn_fee + year_txn_fee')} as all_fees",
        f"{as_double('before_revenue_excl_mva + year_revenue_excl_mva')} as all_revenue",
        f"{as_double('year_revenue_excl_mva')} / cast(days_with_data as double) as daily_revenue",
        f"{as_double('year_total_cost')} / cast(days_with_data as double) as daily_cost",
        "year_orders / cast(days_with_data as double) as daily_orders",
        "daily_revenue * days_in_year as projected_revenue",
        "daily_cost * days_in_year as projected_cost",
        "projected_revenue * if(all_revenue > 0, all_fees / nullif(all_revenue, 0d), 0d) as projected_fees",
        "cost_per_order * (daily_orders * days_in_year) as projected_order_costs",
        "projected_revenue - projected_cost - projected_fees - projected_order_costs - monthly_overhead * 12 as projected_net",
    )
    return figures.selectExpr(
        "as_of",
        "first_order_date",
        "last_order_date",
        "days_with_data",
        f"{as_double('daily_orders')} as daily_orders",
        *[f"{money_out(c)} as {c}" for c in ("daily_revenue", "projected_revenue", "projected_net")],
        f"{as_double(guarded_ratio('projected_net', 'projected_revenue', 100))} as projected_margin_pct",
    )
