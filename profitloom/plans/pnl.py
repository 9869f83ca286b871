"""Profit and loss, fee breakdown, forecast and break-even."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.config import ProfitConfig
from profitloom.functions.money import (
    as_double,
    cast,
    guarded_ratio,
    money_out,
    quote,
    total,
    without_vat,
)
from profitloom.sources.sheets import total_amount

DAYS_PER_MONTH = 30

_SUMS = [
    "gross_sales",
    "total_discount",
    "shipping_revenue",
    "revenue",
    "mva_collected",
    "revenue_excl_mva",
    "total_cost",
    "profit",
    "txn_fee",
    "n_lines",
]


def _statement(df: DataFrame, lines: Sequence[tuple[str, str, int]]) -> DataFrame:
    """One-row table to numbered (line_no, post, amount) rows."""
    rows = ", ".join(
        f"struct({no}L as line_no, {quote(name)} as post, "
        f"{money_out(f'{column} * {sign}')} as amount)"
        for no, (name, column, sign) in enumerate(lines, start=1)
    )
    return df.selectExpr(f"inline(array({rows}))")


def totals(orders: DataFrame) -> DataFrame:
    """One row of unrounded sums over the order table; the base of all K reports.

    Everything comes from one pass with conditional sums. Each order is one row, so
    counting orders needs no distinct.
    """
    present = set(orders.columns)
    return orders.selectExpr(
        "count_if(not is_refunded) as num_orders",
        "count_if(is_refunded) as num_refunded",
        *[f"{total(f'if(is_refunded, null, {c})')} as {c}" for c in _SUMS if c in present],
        "min(if(is_refunded, null, order_date)) as first_day",
        "max(if(is_refunded, null, order_date)) as last_day",
    )


def headline_totals(orders: DataFrame) -> DataFrame:
    names = [
        "revenue",
        "revenue_excl_mva",
        "mva_collected",
        "total_cost",
        "total_discount",
        "shipping_revenue",
    ]
    return totals(orders).selectExpr(
        "num_orders",
        "num_refunded",
        f"{cast('n_lines', 'bigint')} as n_lines",
        *[f"{money_out(c)} as {c}" for c in names],
        f"{money_out('revenue_excl_mva - total_cost')} as gross_profit",
    )


_MONTHS = (
    f"greatest(coalesce(datediff(last_day, first_day), 0) / {float(DAYS_PER_MONTH)}d, 1d)"
    " as months"
)


def _with_sheet_totals(df: DataFrame, fixed: DataFrame, per_order: DataFrame | None) -> DataFrame:
    scalars = {"monthly_overhead": total_amount(fixed).scalar().cast("double")}
    if per_order is not None:
        scalars["cost_per_order"] = total_amount(per_order).scalar().cast("double")
    return df.withColumns(scalars)


def overhead_for_period(orders: DataFrame, fixed: DataFrame) -> DataFrame:
    """Months covered by the active orders and the overhead that falls on them."""
    row = _with_sheet_totals(totals(orders).selectExpr(_MONTHS), fixed, None)
    return row.selectExpr(
        f"{as_double('months')} as months_covered",
        f"{money_out('monthly_overhead')} as monthly_overhead",
        f"{money_out('monthly_overhead * months')} as total_overhead",
    )


def profit_and_loss(orders: DataFrame, fixed: DataFrame, per_order: DataFrame) -> DataFrame:
    """One unrounded row from gross sales to net result."""
    return _with_sheet_totals(totals(orders), fixed, per_order).selectExpr(
        "*",
        _MONTHS,
        f"{as_double('revenue_excl_mva - total_cost')} as gross_profit",
        f"{as_double('txn_fee')} as fees",
        f"{as_double('revenue_excl_mva')} as net_sales",
        "cost_per_order * num_orders as order_costs",
        "monthly_overhead * months as overhead",
        "gross_profit - (fees + order_costs) - overhead as net_profit",
    )


def net_result(pnl: DataFrame) -> DataFrame:
    return pnl.selectExpr(
        f"{money_out('gross_profit')} as gross_profit",
        f"{money_out('fees')} as total_txn_fees",
        f"{money_out('order_costs')} as total_per_order_fixed",
        f"{money_out('fees + order_costs')} as total_per_order_costs",
        f"{money_out('overhead')} as total_fixed_overhead",
        f"{money_out('net_profit')} as net_profit",
        f"{as_double(guarded_ratio('net_profit', 'net_sales', 100))} as net_margin_pct",
    )


# The statement's lines in order; the VAT rate is filled in.
PNL_LINES = (
    ("Brutto varesalg (inkl. MVA)", "gross_sales", 1),
    ("Rabatter gitt", "total_discount", -1),
    ("Fraktinntekter", "shipping_revenue", 1),
    ("Total omsetning (inkl. MVA)", "revenue", 1),
    ("MVA til staten ({vat}%)", "mva_collected", -1),
    ("Omsetning (eksl. MVA)", "revenue_excl_mva", 1),
    ("Varekostnad (COGS)", "total_cost", -1),
    ("Bruttofortjeneste", "gross_profit", 1),
    ("Transaksjonsgebyrer", "fees", -1),
    ("Ordrekostnader", "order_costs", -1),
    ("Faste kostnader", "overhead", -1),
    ("Netto resultat", "net_profit", 1),
)


def pnl_statement(pnl: DataFrame, cfg: ProfitConfig) -> DataFrame:
    vat = f"{float(cfg.vat_rate * 100):g}"
    return _statement(pnl, [(name.format(vat=vat), *rest) for name, *rest in PNL_LINES])


def fee_breakdown(orders: DataFrame, rate: Column) -> DataFrame:
    """Fees and rates of orders with a charged fee and of those with an estimate.

    Both rows are always there, with zeros where no order is of the kind.
    ``shown_rate_pct`` is the rate to report: measured for charged fees, the wallet
    rate itself for estimates.
    """
    kinds = {"actual": "actual_fee is not null", "estimated": "actual_fee is null"}
    sums = [
        part
        for kind, holds in kinds.items()
        for part in (
            f"count_if({holds}) as {kind}_orders",
            f"{total(f'if({holds}, txn_fee, null)')} as {kind}_fees",
            f"{total(f'if({holds}, revenue_excl_mva, null)')} as {kind}_sales",
        )
    ]
    rows = ", ".join(
        f"struct('{kind}' as fee_source, {kind}_orders as orders, {kind}_fees as fee_sum, "
        f"{kind}_sales as sales)"
        for kind in kinds
    )
    by_source = orders.selectExpr(*sums).selectExpr(f"inline(array({rows}))")
    by_source = by_source.withColumn("wallet_rate", rate)
    return by_source.selectExpr(
        "fee_source",
        "orders",
        f"{money_out('fee_sum')} as fees",
        f"{money_out('sales')} as revenue_excl_mva",
        f"{as_double(guarded_ratio('fee_sum', 'sales', 100))} as measured_rate_pct",
        "if(fee_source = 'actual', measured_rate_pct, "
        f"{as_double('wallet_rate * 100d')}) as shown_rate_pct",
    )


def overall_fee_rate(orders: DataFrame) -> DataFrame:
    """All fees, and their share of sales in percent."""
    return totals(orders).selectExpr(
        f"{money_out('txn_fee')} as total_txn_fees",
        f"{as_double(guarded_ratio('txn_fee', 'revenue_excl_mva', 100))} as avg_fee_rate_pct",
    )


def cost_table(costs: DataFrame, total_name: str) -> DataFrame:
    """The costs of a sheet with a total row (is_total tells it apart)."""
    rolled = costs.rollup("name").agg(
        F.sum("amount").alias("amount"), F.grouping("name").alias("is_total")
    )
    return rolled.selectExpr(
        f"if(is_total = 1, {quote(total_name)}, name) as cost_name",
        f"{money_out('coalesce(amount, 0)')} as amount",
        "cast(is_total as int) as is_total",
    )


def fixed_cost_table(fixed: DataFrame) -> DataFrame:
    return cost_table(fixed, C.MONTHLY_TOTAL)


def order_cost_table(per_order: DataFrame, orders: DataFrame) -> DataFrame:
    """Per-order costs with total row, and what each comes to over all active orders."""
    count = totals(orders).select("num_orders").scalar()
    listed = cost_table(per_order, C.PER_ORDER_TOTAL).withColumn("num_orders", count)
    return listed.selectExpr(
        "cost_name",
        "amount",
        "is_total",
        f"{money_out('amount * num_orders')} as amount_all_orders",
    )


def year_forecast(
    orders: DataFrame, fixed: DataFrame, per_order: DataFrame, cfg: ProfitConfig
) -> DataFrame:
    """The year of ``as_of`` projected from its own daily averages; no row without orders."""
    first, last = date(cfg.as_of.year, 1, 1), date(cfg.as_of.year, 12, 31)
    days_in_year = float((last - first).days + 1)
    in_year = f"(not is_refunded and order_date between date'{first}' and date'{last}')"
    summed = lambda name, when: as_double(total(f"if({when}, {name}, null)"))
    sums = orders.selectExpr(
        f"min(if({in_year}, order_date, null)) as first_order_date",
        f"max(if({in_year}, order_date, null)) as last_order_date",
        f"count_if({in_year}) as year_orders",
        f"{summed('revenue_excl_mva', in_year)} as year_revenue",
        f"{summed('total_cost', in_year)} as year_cost",
        f"{summed('txn_fee', 'not is_refunded')} as all_fees",
        f"{summed('revenue_excl_mva', 'not is_refunded')} as all_revenue",
    ).filter("year_orders > 0")
    days = "cast(days_with_data as double)"
    return _with_sheet_totals(sums, fixed, per_order).selectExpr(
        "*",
        "cast(datediff(last_order_date, first_order_date) + 1 as bigint) as days_with_data",
        f"year_revenue / {days} as daily_revenue",
        f"year_cost / {days} as daily_cost",
        f"year_orders / {days} as daily_orders",
        f"daily_revenue * {days_in_year}d as projected_revenue",
        f"daily_cost * {days_in_year}d as projected_cost",
        f"daily_orders * {days_in_year}d as projected_orders",
        "projected_revenue * if(all_revenue > 0, all_fees / nullif(all_revenue, 0d), 0d)"
        " as projected_fees",
        "cost_per_order * projected_orders as projected_order_costs",
        "monthly_overhead * 12 as projected_overhead",
        "projected_revenue - projected_cost - projected_fees - projected_order_costs"
        " - projected_overhead as projected_net",
    )


def forecast_figures(forecast: DataFrame) -> DataFrame:
    margin = guarded_ratio("projected_net", "projected_revenue", 100)
    return forecast.selectExpr(
        "first_order_date",
        "last_order_date",
        "days_with_data",
        f"{as_double('daily_orders')} as daily_orders",
        *[
            f"{money_out(c)} as {c}"
            for c in ("daily_revenue", "projected_revenue", "projected_net")
        ],
        f"{as_double(margin)} as projected_margin_pct",
    )


# The forecast's lines in order.
FORECAST_LINES = (
    ("Projisert omsetning (eksl. MVA)", "projected_revenue", 1),
    ("Projisert varekostnad", "projected_cost", -1),
    ("Projisert transaksjonsgebyrer", "projected_fees", -1),
    ("Projisert ordrekostnader", "projected_order_costs", -1),
    ("Faste kostnader (12 mnd)", "projected_overhead", -1),
    ("Projisert netto resultat", "projected_net", 1),
)


def forecast_statement(forecast: DataFrame) -> DataFrame:
    return _statement(forecast, FORECAST_LINES)


def break_even(pnl: DataFrame) -> DataFrame:
    """Contribution per order, orders a month to cover overhead, and orders a month now."""
    contribution = guarded_ratio("gross_profit - (fees + order_costs)", "num_orders")
    row = pnl.selectExpr(
        f"{contribution} as contribution", "monthly_overhead", "num_orders", "months"
    )
    needed = "if(contribution > 0, monthly_overhead / nullif(contribution, 0d), 0d)"
    return row.selectExpr(
        f"{money_out('contribution')} as contribution_per_order",
        f"{as_double(needed)} as break_even_orders",
        f"{as_double('num_orders / months')} as orders_per_month",
    )


def price_scenario(
    products: DataFrame, factors: Sequence[Decimal], cfg: ProfitConfig
) -> DataFrame:
    """What a product earns at several sell prices (product_key, cost_price, sell_price).

    Each product is opened into one row per factor of its price, inside its own row.
    """
    grid = ", ".join(f"cast({factor:f} as decimal(6,4))" for factor in factors)
    opened = products.selectExpr(
        "product_key", "cost_price", "sell_price", f"explode(array({grid})) as factor"
    ).selectExpr(
        "product_key",
        "cast(factor as double) as price_factor",
        f"{as_double('cost_price')} as cost",
        "cast(sell_price * factor as decimal(18,4)) as gross",
    )
    net = without_vat("gross", cfg.vat_rate)
    wallet, card = float(cfg.scenario_wallet_rate), float(cfg.scenario_card_rate)
    priced = opened.filter("gross > 0").selectExpr(
        "*",
        f"{as_double(net)} as net",
        f"{as_double(f'gross - {net}')} as vat",
        "net - cost as earned",
        f"net * {wallet}d as by_wallet",
        f"net * {card}d + {float(cfg.scenario_card_fixed)}d as by_card",
    )
    return priced.selectExpr(
        "product_key",
        "price_factor",
        f"{money_out('gross')} as sell_price",
        f"{money_out('net')} as sell_price_excl_mva",
        f"{money_out('vat')} as mva",
        f"{money_out('earned')} as gross_profit",
        f"{as_double(guarded_ratio('earned', 'net', 100))} as margin_pct",
        f"{money_out('by_wallet')} as wallet_fee",
        f"{money_out('earned - by_wallet')} as net_after_wallet_fee",
        f"{money_out('by_card')} as card_fee",
        f"{money_out('earned - by_card')} as net_after_card_fee",
    )
