"""Records (R1, R2, R4, R5).

A record is the largest value; among equals the smallest key wins. The smallest
(negated value, key) pair says both, for any key type and in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from profitloom.functions.frames import grouped
from profitloom.functions.money import money_out, total
from profitloom.plans.customers import known_customers
from profitloom.plans.trends import WEEK

_SALES = f"{total('revenue_excl_mva')} as sales"
_PROFIT = f"{total('profit')} as profit"
_ORDERS = "count(1) as orders"


def _record(metric: str, key: str, name: str, *also: str) -> str:
    values = ", ".join([f"-{metric} as neg", f"{key} as key", *also])
    return f"min(struct({values})) as {name}"


def best_day(orders: DataFrame) -> DataFrame:
    """Day with most revenue, and day with most orders."""
    row = grouped(orders, ["order_date"], _SALES, _ORDERS).selectExpr(
        _record("sales", "order_date", "s"), _record("orders", "order_date", "o")
    )
    return row.selectExpr(
        "s.key as revenue_day",
        f"{money_out('-s.neg')} as revenue_excl_mva",
        "o.key as orders_day",
        "-o.neg as orders",
    )


def best_week(orders: DataFrame) -> DataFrame:
    """Weeks with most revenue, profit and orders."""
    row = grouped(orders, [WEEK], _SALES, _PROFIT, _ORDERS).selectExpr(
        _record("sales", "week", "s"),
        _record("profit", "week", "p"),
        _record("orders", "week", "o"),
    )
    return row.selectExpr(
        "s.key as revenue_week",
        f"{money_out('-s.neg')} as revenue_excl_mva",
        "p.key as profit_week",
        f"{money_out('-p.neg')} as profit",
        "o.key as orders_week",
        "-o.neg as orders",
    )


def biggest_order(orders: DataFrame) -> DataFrame:
    row = orders.selectExpr(_record("revenue_excl_mva", "order_number", "r", "order_date"))
    return row.filter("r is not null").selectExpr(
        "r.key as order_number",
        "r.order_date as order_date",
        f"{money_out('-r.neg')} as revenue_excl_mva",
    )


def best_customer(orders: DataFrame) -> DataFrame:
    """Customer with most orders; no row when no order has an email."""
    customers = grouped(known_customers(orders), ["customer_email"], _ORDERS, _SALES)
    row = customers.selectExpr(_record("orders", "customer_email", "r", "sales"))
    return row.filter("r is not null").selectExpr(
        "r.key as customer_email",
        "-r.neg as orders",
        f"{money_out('r.sales')} as revenue_excl_mva",
    )
