"""Discount codes and shipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.functions.frames import grouped
from profitloom.functions.money import MONEY, as_double, cast, money_out, quote, total


def discount_usage(orders: DataFrame) -> DataFrame:
    """Orders, discount, revenue and profit per code, most used first.

    ``first_line_discount`` counts the discount on each order's first line only;
    ``all_line_discount`` counts all of it.
    """
    return grouped(
        orders,
        ["discount_code"],
        "count(1) as orders",
        f"{money_out(total('first_line_discount'))} as first_line_discount",
        f"{money_out(total('total_discount'))} as all_line_discount",
        f"{money_out(total('revenue_excl_mva'))} as revenue_excl_mva",
        f"{money_out(total('profit'))} as profit",
    ).orderBy(F.col("orders").desc(), "discount_code")


def _by_code(orders: DataFrame) -> DataFrame:
    """Per code, sums over the orders that count as discounted and over the others."""
    used = f"(discount_code <> {quote(C.NO_DISCOUNT)} and total_discount > 0)"
    return grouped(
        orders,
        ["discount_code"],
        f"count_if({used}) as orders",
        f"{total(f'if({used}, revenue_excl_mva, null)')} as sales",
        f"{total(f'if({used}, total_discount, null)')} as discount",
        f"count_if(not {used}) as plain_orders",
        f"{total(f'if({used}, null, revenue_excl_mva)')} as plain_sales",
    )


def _baseline(codes: DataFrame) -> DataFrame:
    mean = f"{as_double('sum(plain_sales)')} / cast(nullif(sum(plain_orders), 0) as double)"
    return codes.selectExpr(f"coalesce({mean}, 0d) as mean")


def discount_baseline(orders: DataFrame) -> DataFrame:
    """Mean order value of orders without a code or without any discount."""
    return _baseline(_by_code(orders)).selectExpr(f"{money_out('mean')} as baseline_aov")


def discount_profitability(orders: DataFrame) -> DataFrame:
    """Mean order value per code against the baseline, highest revenue first."""
    codes = _by_code(orders)
    compared = (
        codes.filter("orders > 0")
        .selectExpr("*", f"{as_double('sales')} / cast(orders as double) as mean")
        .withColumn("baseline", _baseline(codes).scalar())
    )
    higher, lower = quote(C.HIGHER_ORDER_VALUE), quote(C.LOWER_ORDER_VALUE)
    return compared.orderBy(F.col("sales").desc(), "discount_code").selectExpr(
        "discount_code",
        "orders",
        f"{money_out('mean')} as mean_order_value",
        f"{money_out('baseline')} as baseline_aov",
        f"{money_out('discount')} as total_discount",
        f"{money_out('sales')} as revenue_excl_mva",
        f"if(mean > baseline, {higher}, {lower}) as verdict",
    )


def shipping_cost_per_order(per_order: DataFrame) -> Column:
    """The sheet's shipping estimate as a scalar, 0 when it is not listed."""
    listed = per_order.filter(F.col("name") == C.SHIPPING_COST_NAME)
    return listed.selectExpr(f"{cast(total('amount'), MONEY)} as amount").scalar()


def shipping_result(orders: DataFrame, shipping_cost: Column) -> DataFrame:
    """Shipping income less the estimated shipping cost of all orders."""
    sums = orders.selectExpr(
        f"{total('shipping_revenue')} as income", "count(1) as orders"
    ).withColumn("shipping_cost", shipping_cost)
    return sums.selectExpr(
        f"{money_out('income')} as shipping_revenue",
        f"{money_out('shipping_cost * orders')} as estimated_shipping_cost",
        f"{money_out('income - shipping_cost * orders')} as shipping_result",
    )
