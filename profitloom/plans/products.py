"""Product reports.

Lines are summed per product before the cost sheet is joined: the join is then
between two tables of product size, and a best-selling product is one row of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom.config import ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import (
    SHARE_UNITS,
    cast,
    from_units,
    margin_pct,
    money_out,
    sum_units,
    total,
    without_vat,
)
from profitloom.sources.sheets import CostLookup


def product_sums(lines: DataFrame, costs: CostLookup, cfg: ProfitConfig) -> DataFrame:
    """Per product key and title: revenue and quantity, all and with a known cost.

    ``lines`` are allocated lines. VAT is taken off the sums, which is the same as
    taking it off each line.
    """
    gross = sum_units("value_units - discount_units + shipping_units")
    revenue = f"{gross} - {sum_units('share_units', SHARE_UNITS)}"
    summed = grouped(
        lines.filter("product_title is not null"),
        ["product_key", "product_title"],
        f"{without_vat(revenue, cfg.vat_rate)} as sales",
        "sum(quantity) as units",
        "count(1) as line_count",
    )
    lookup = F.broadcast(costs.weights) if costs.fits else costs.weights
    weighed = summed.join(lookup, "product_key", "left").selectExpr(
        "product_key",
        "product_title",
        "sales as one_sales",
        "units as one_units",
        "line_count",
        "coalesce(copies, 1L) as copies",
        "coalesce(priced, 0L) as priced",
        f"coalesce({from_units('cost_units')}, 0) as unit_cost",
    )
    return weighed.selectExpr(
        "product_key",
        "product_title",
        "priced",
        "one_sales * copies as sales",
        "one_units * copies as units",
        "one_sales * priced as priced_sales",
        "one_units * priced as priced_units",
        "unit_cost * one_units as cost",
        "one_sales * (copies - priced) as unpriced_sales",
        "one_units * (copies - priced) as unpriced_units",
        "line_count * (copies - priced) as unpriced_lines",
    )


def by_title(sums: DataFrame) -> DataFrame:
    names = ["sales", "units", "priced_sales", "priced_units", "cost", "priced"]
    titles = grouped(sums, ["product_title"], *[f"{total(c)} as {c}" for c in names])
    return titles.selectExpr("*", f"{cast('priced_sales - cost', 'decimal(32,10)')} as profit")


def _top(df: DataFrame, metric: str, cfg: ProfitConfig) -> DataFrame:
    return df.orderBy(F.expr(metric).desc(), "product_title").limit(cfg.top_n)


def top_products_profit(titles: DataFrame, cfg: ProfitConfig) -> DataFrame:
    return _top(titles, "profit", cfg).selectExpr(
        "product_title",
        f"{money_out('profit')} as profit",
        f"{money_out('sales')} as revenue_excl_mva",
        "cast(units as bigint) as quantity",
    )


def product_margin(titles: DataFrame) -> DataFrame:
    """Products with a known cost, best margin first."""
    return (
        titles.filter("priced > 0")
        .selectExpr(
            "product_title",
            f"{money_out('priced_sales')} as revenue_excl_mva",
            f"{money_out('cost')} as total_cost",
            f"{money_out('profit')} as profit",
            "cast(priced_units as bigint) as quantity",
            f"{margin_pct('profit', 'priced_sales')} as margin_pct",
        )
        .orderBy(F.col("margin_pct").desc(), "product_title")
    )


def best_sellers(titles: DataFrame, cfg: ProfitConfig) -> DataFrame:
    return _top(titles, "units", cfg).selectExpr(
        "product_title",
        "cast(units as bigint) as quantity",
        f"{money_out('sales')} as revenue_excl_mva",
    )


def contribution_margin(titles: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Sales less unit cost times quantity, for products with a known cost."""
    return _top(titles.filter("priced > 0"), "profit", cfg).selectExpr(
        "product_title",
        f"{money_out('profit')} as contribution",
        f"{money_out('priced_sales')} as revenue_excl_mva",
        "cast(priced_units as bigint) as quantity",
    )


def _unmatched(sums: DataFrame) -> DataFrame:
    names = ["unpriced_sales", "unpriced_units", "unpriced_lines"]
    return grouped(sums, ["product_key"], *[f"{total(c)} as {c}" for c in names]).filter(
        "unpriced_lines > 0"
    )


def unmatched_products(sums: DataFrame) -> DataFrame:
    """Products sold without a cost on the sheet, highest revenue first."""
    return (
        _unmatched(sums)
        .orderBy(F.col("unpriced_sales").desc(), "product_key")
        .selectExpr(
            "product_key",
            "cast(unpriced_units as bigint) as quantity",
            f"{money_out('unpriced_sales')} as revenue_excl_mva",
        )
    )


def unmatched_headline(sums: DataFrame) -> DataFrame:
    return _unmatched(sums).selectExpr(
        "count(1) as products", f"{cast(total('unpriced_lines'), 'bigint')} as n_lines"
    )


def best_product(titles: DataFrame) -> DataFrame:
    """Product with most revenue, profit and quantity; first by name among equals."""
    row = titles.selectExpr(
        *[
            f"min(struct(-{metric} as neg, product_title)) as {metric}"
            for metric in ("sales", "profit", "units")
        ]
    )
    return row.selectExpr(
        "sales.product_title as revenue_product",
        f"{money_out('-sales.neg')} as revenue_excl_mva",
        "profit.product_title as profit_product",
        f"{money_out('-profit.neg')} as profit",
        "units.product_title as quantity_product",
        "cast(-units.neg as bigint) as quantity",
    )
