"""Order and line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.functions.frames import grouped
from profitloom.functions.money import as_double, margin_pct, money_out, rounded
from profitloom.operators.lines import weigh_lines
from profitloom.sources.sheets import CostLookup


def open_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("fulfillment_status") == C.UNFULFILLED)


def unfulfilled_count(orders: DataFrame) -> DataFrame:
    return open_orders(orders).selectExpr("count(1) as open_orders")


def unfulfilled_orders(
    orders: DataFrame, lines: DataFrame, costs: CostLookup | None = None
) -> DataFrame:
    """Open orders with revenue and their products in line order, newest first.

    One row per order. Lines are ranged over tasks by order and position; each part of an
    order becomes a text, and an order's texts are joined by part. A product listed twice in
    the cost sheet is named twice, as its line counts twice.
    """
    keys = ["order_number", "order_date", "city", "revenue_excl_mva"]
    products, text = lines.select("order_number", "line_pos", "product_key"), "product_key"
    if costs is not None and costs.repeats:
        products = weigh_lines(products, costs)
        text = "array_join(array_repeat(product_key, cast(copies as int)), ', ')"
    ranged = (
        open_orders(orders)
        .select(*keys)
        .join(products, "order_number")
        .selectExpr(*keys, "line_pos", f"{text} as product")
        .repartitionByRange("order_number", "line_pos")
        .selectExpr("*", "spark_partition_id() as part")
    )
    pieces = grouped(
        ranged, [*keys, "part"], "listagg(product, ', ') within group (order by line_pos) as piece"
    )
    texts = grouped(pieces, keys, "listagg(piece, ', ') within group (order by part) as products")
    return texts.orderBy(F.col("order_date").desc(), "order_number").selectExpr(
        "order_number", "order_date", "city", *rounded("revenue_excl_mva"), "products"
    )


def orders_summary(orders: DataFrame) -> DataFrame:
    """Every order with revenue, cost, profit and margin, newest first."""
    return orders.orderBy(F.col("order_date").desc(), "order_number").selectExpr(
        "order_number",
        "order_date",
        "financial_status",
        *rounded("revenue_excl_mva", "total_cost", "profit"),
        f"{margin_pct('profit', 'revenue_excl_mva')} as margin_pct",
    )


def line_detail(lines: DataFrame) -> DataFrame:
    """Every line with its cost and profit, newest first.

    The sort key goes on to order and line, so a very busy day is ranged over many
    tasks.
    """
    return lines.orderBy(F.col("order_date").desc(), "order_number", "line_pos").selectExpr(
        "order_number",
        "order_date",
        "product_key",
        "quantity",
        f"{as_double('unit_price')} as unit_price",
        f"{money_out('revenue_excl_mva')} as revenue_excl_mva",
        f"{as_double('cost_price')} as cost_price",
        f"{money_out('total_cost')} as total_cost",
        f"{money_out('profit')} as profit",
        "margin_pct",
    )
