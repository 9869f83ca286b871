"""Customer, payment and city reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.config import ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import as_double, guarded_ratio, money_out, quote, total


def known_customers(orders: DataFrame) -> DataFrame:
    """Orders with an email; absent and empty ones do not make a customer."""
    return orders.filter("coalesce(customer_email, '') <> ''")


def _orders_per_customer(orders: DataFrame) -> DataFrame:
    return grouped(known_customers(orders), ["customer_email"], "count(1) as orders")


def repeat_customers(orders: DataFrame) -> DataFrame:
    rate = guarded_ratio("count_if(orders >= 2)", "count(1)", 100)
    return _orders_per_customer(orders).selectExpr(
        "count(1) as unique_customers",
        "count_if(orders >= 2) as repeat_customers",
        f"{as_double(rate)} as repeat_rate_pct",
    )


def order_frequency(orders: DataFrame) -> DataFrame:
    """Customers with one, two, and three or more orders; always three rows."""
    # The three labels.
    buckets = {"1 bestilling": "= 1", "2 bestillinger": "= 2", "3+ bestillinger": ">= 3"}
    counts = _orders_per_customer(orders).selectExpr(
        *[f"count_if(orders {size}) as `{label}`" for label, size in buckets.items()]
    )
    return counts.unpivot([], list(buckets), "order_frequency", "customers")


def payment_summary(orders: DataFrame) -> DataFrame:
    """Orders and revenue per payment method, highest revenue first."""
    names = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in C.PAYMENT_NAMES.items())
    summed = grouped(
        orders,
        ["payment_method"],
        "count(1) as orders",
        f"{total('revenue_excl_mva')} as sales",
    )
    return summed.orderBy(F.col("sales").desc(), "payment_method").selectExpr(
        f"case payment_method {names} else payment_method end as payment_method",
        "orders",
        f"{money_out('sales')} as revenue_excl_mva",
    )


def city_top(orders: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Cities with most orders."""
    summed = grouped(
        orders, ["city"], "count(1) as orders", f"{total('revenue_excl_mva')} as sales"
    )
    return (
        summed.orderBy(F.col("orders").desc(), "city")
        .limit(cfg.top_n)
        .selectExpr("city", "orders", f"{money_out('sales')} as revenue_excl_mva")
    )
