"""Order grain: totals, first values and transaction fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.config import ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import (
    AMOUNT,
    MONEY,
    SHARE,
    SHARE_UNITS,
    cast,
    from_units,
    quote,
    sum_units,
    total,
    without_vat,
)
from profitloom.operators.lines import VALUE_UNITS, is_refunded, share_units, weigh_lines
from profitloom.sources.sheets import CostLookup


def _first(name: str) -> str:
    """First value of the order that is not missing, in line order."""
    return f"min_by({name}, line_pos) filter (where {name} is not null) as {name}"


def _summed(name: str) -> str:
    return f"{cast(total(name), AMOUNT)} as {name}"


# --- from enriched lines --------------------------------------------------------


def order_level(lines: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Id, payment method and revenue per order."""
    per_order = grouped(
        lines, ["order_number"], _first("order_id"), _first("payment_method"), _summed("revenue")
    )
    net = without_vat("revenue", cfg.vat_rate)
    return per_order.selectExpr("*", f"{net} as revenue_excl_mva")


def order_totals(lines: DataFrame) -> DataFrame:
    """Date, sums, code and customer per order."""
    return grouped(
        lines,
        ["order_number"],
        "min(order_date) as order_date",
        _summed("revenue_excl_mva"),
        _summed("total_cost"),
        _summed("total_discount"),
        _summed("shipping_revenue"),
        _first("discount_code"),
        _first("customer_email"),
    )


# --- from headers and raw lines -------------------------------------------------


def with_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers of the orders that have any line.

    Order numbers are made distinct first, so a huge order is one row of the join.
    """
    return headers.join(lines.select("order_number").distinct(), "order_number", "left_semi")


def order_table(
    headers: DataFrame,
    lines: DataFrame,
    cfg: ProfitConfig,
    costs: CostLookup | None = None,
    first_line: bool = False,
) -> DataFrame:
    """One row per order with every total the reports need.

    Lines are summed per order before they meet the header, so header fields never
    travel at line grain and the join is between two one-row-per-order sides. An
    order's discount shares add up to its left-over discount and its shipping sits
    on its first line, so no line has to be allocated to know the order's totals.

    Without ``costs`` there are no cost and profit columns, and every line counts
    once. ``first_line`` adds the discount on the first line alone.
    """
    rows = lines.selectExpr("*", f"{VALUE_UNITS} as value_units")
    if costs is not None:
        rows = weigh_lines(rows, costs)
    per_order = grouped(rows, ["order_number"], *_line_sums(costs, first_line))
    joined = headers.join(per_order, "order_number")

    repeats = costs is not None and costs.repeats
    gross = "gross_sales" if repeats else "items_value"
    own = "own_discount" if repeats else "own_items_discount"
    shipping = "greatest(order_shipping, 0)"
    kept = [c for c in headers.columns if c not in ("order_shipping", "undistributed_discount")]
    columns = [
        *kept,
        "n_lines",
        f"{is_refunded(cfg)} as is_refunded",
        gross if repeats else f"{gross} as gross_sales",
        f"{cast(f'{own} + {_share(gross)}', AMOUNT)} as total_discount",
        f"{cast(f'{shipping} * first_copies' if repeats else shipping, MONEY)} as shipping_revenue",
        f"{cast(f'{gross} - total_discount + shipping_revenue', AMOUNT)} as revenue",
        f"{without_vat('revenue', cfg.vat_rate)} as revenue_excl_mva",
        f"{cast('revenue - revenue_excl_mva', AMOUNT)} as mva_collected",
    ]
    if first_line:
        discount = f"first_discount + {_share('first_value')}"
        columns.append(f"{cast(discount, AMOUNT)} as first_line_discount")
    if costs is not None:
        priced = (
            f"priced_value - priced_discount - {_share('priced_value')} "
            f"+ {shipping} * first_priced"
        )
        columns += [
            "unpriced_lines",
            "total_cost",
            f"{without_vat(cast(priced, AMOUNT), cfg.vat_rate)} as priced_revenue_excl_mva",
            f"{cast('priced_revenue_excl_mva - total_cost', AMOUNT)} as profit",
        ]
    return joined.selectExpr(*columns)


def _share(value: str) -> str:
    return from_units(share_units(f"cast({value} as double)"), SHARE_UNITS, SHARE)


def _line_sums(costs: CostLookup | None, first_line: bool) -> list[str]:
    """Sums over an order's lines; weighted by listings only where a key repeats."""
    sums = [
        f"{sum_units('value_units')} as items_value",
        f"{sum_units('discount_units')} as own_items_discount",
    ]
    repeats = costs is not None and costs.repeats
    if repeats:
        sums += [
            "sum(copies) as n_lines",
            f"{sum_units('value_units * copies')} as gross_sales",
            f"{sum_units('discount_units * copies')} as own_discount",
        ]
    else:
        sums.append("count(1) as n_lines")
    # Values of the first line; whole numbers by position, so the aggregate hashes.
    if costs is not None:
        sums += [
            f"sum({'copies' if repeats else '1L'} - priced) as unpriced_lines",
            f"{sum_units('value_units * priced')} as priced_value",
            f"{sum_units('discount_units * priced')} as priced_discount",
            f"{cast(sum_units('cost_units * quantity'), AMOUNT)} as total_cost",
        ]
        sums.append("min_by(priced, line_pos) as first_priced")
    if repeats:
        sums.append("min_by(copies, line_pos) as first_copies")
    if first_line:
        sums += [
            f"{from_units('min_by(value_units, line_pos)')} as first_value",
            f"{from_units('min_by(discount_units, line_pos)')} as first_discount",
        ]
    return sums


def with_actual_fee(orders: DataFrame, card_fees: DataFrame) -> DataFrame:
    """The fee charged for the order, missing where no charge is known."""
    return orders.join(card_fees, "order_id", "left")


def wallet_rate(wallet: DataFrame, cfg: ProfitConfig) -> Column:
    """Average wallet rate as a scalar, or the fallback without wallet data."""
    rate = f"case when avg_rate > 0 then avg_rate else {float(cfg.wallet_fallback_rate)}d end"
    return wallet.selectExpr(f"{rate} as rate").scalar()


def with_txn_fee(
    orders: DataFrame,
    card_fees: DataFrame,
    wallet: DataFrame,
    rules: DataFrame,
    cfg: ProfitConfig,
) -> DataFrame:
    """Fee per order: the charged one, else the wallet rate, else the card rule."""
    card_rule = (
        rules.filter(F.col("method") == C.CARD_METHOD)
        .selectExpr("struct(cast(rate as double) as rate, cast(fixed as double) as fixed) as rule")
        .scalar()
    )
    with_rules = with_actual_fee(orders, card_fees).withColumns(
        {"wallet_rate": wallet_rate(wallet, cfg), "card_rule": card_rule}
    )
    net = "cast(revenue_excl_mva as double)"
    estimate = (
        f"case when contains(lower(payment_method), {quote(C.WALLET_MARKER)}) "
        f"then {net} * wallet_rate "
        f"else {net} * coalesce(card_rule.rate, 0d) + coalesce(card_rule.fixed, 0d) end"
    )
    fee = f"coalesce(actual_fee, {cast(estimate, 'decimal(24,9)')})"
    return with_rules.selectExpr("*", f"{cast(fee, AMOUNT)} as txn_fee").drop(
        "wallet_rate", "card_rule"
    )
