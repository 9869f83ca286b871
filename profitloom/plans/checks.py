"""Checks on the inputs and on the books (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from profitloom.functions.frames import grouped
from profitloom.functions.money import (
    SHARE_UNITS,
    as_double,
    cast,
    guarded_ratio,
    money_out,
    sum_units,
    total,
)
from profitloom.plans.pnl import totals


def cost_coverage(orders: DataFrame) -> DataFrame:
    """Share of lines and of revenue that has a known cost."""
    sums = orders.selectExpr(
        f"{cast(total('n_lines'), 'bigint')} as n_lines",
        f"{cast(total('n_lines - unpriced_lines'), 'bigint')} as priced_lines",
        f"{total('revenue_excl_mva')} as sales",
        f"{total('priced_revenue_excl_mva')} as priced_sales",
    )
    return sums.selectExpr(
        "n_lines",
        "priced_lines",
        f"{as_double(guarded_ratio('priced_lines', 'n_lines', 100))} as lines_pct",
        f"{money_out('sales')} as revenue_excl_mva",
        f"{money_out('priced_sales')} as priced_revenue_excl_mva",
        f"{as_double(guarded_ratio('priced_sales', 'sales', 100))} as revenue_pct",
    )


def duplicate_cost_keys(costs: DataFrame) -> DataFrame:
    """Keys listed more than once, each of which repeats its lines in the cost join."""
    return grouped(costs, ["product_key"], "count(1) as listings").filter("listings > 1")


def reconciliation(orders: DataFrame) -> DataFrame:
    """Do the books add up: one row per identity, both sides and their difference."""
    sides = {
        "sales": "gross_sales - total_discount + shipping_revenue",
        "vat": "revenue_excl_mva + mva_collected",
    }
    rows = ", ".join(
        f"struct('{name}' as identity, {money_out(left)} as left_side, "
        f"{money_out('revenue')} as right_side, "
        f"{money_out(f'{left} - revenue')} as difference)"
        for name, left in sides.items()
    )
    return totals(orders).selectExpr(f"inline(array({rows}))")


def allocation_check(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Allocated discount and shipping against what the order headers hold.

    ``lines`` are allocated lines. An order whose items are worth nothing has its
    discount left unallocated.
    """
    per_order = grouped(
        lines,
        ["order_number"],
        f"{sum_units('share_units', SHARE_UNITS)} as share",
        f"{sum_units('shipping_units')} as shipping",
        f"{sum_units('value_units')} as value",
        "count(1) as n_lines",
    )
    due = "if(value > 0, undistributed_discount, 0)"
    return headers.join(per_order, "order_number").selectExpr(
        "count(1) as orders",
        f"count_if(abs(share - {due}) > n_lines * 0.00001) as orders_with_share_gap",
        "count_if(abs(shipping - order_shipping) > 0) as orders_with_shipping_gap",
    )
