"""Hand-kept cost sheets landed as CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from profitloom import config as C
from profitloom.functions.frames import grouped
from profitloom.functions.money import MONEY, cast, quote, to_units, total
from profitloom.functions.text import (
    fee_fixed,
    fee_rate,
    parse_currency,
    parse_fixed_amount,
    strip,
)
from profitloom.schemas import COST_ROW

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_BYTES = 64  # generous size of a lookup row besides its key


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with its own header row, every cell as text."""
    return spark.read.option("header", True).csv(path)


def read_cost_rows(spark: SparkSession, path: str) -> DataFrame:
    """A two-column sheet plus the row's place in it."""
    return spark.read.option("header", True).schema(COST_ROW).csv(path)


def product_costs(sheet: DataFrame) -> DataFrame:
    """Unit cost per product key (product_key, cost_price).

    Columns are found by their heading; if the cost heading is not recognised the
    first two columns are taken by position.
    """
    named = sheet.withColumnsRenamed(C.COST_SHEET_HEADERS)
    if "cost_price" not in named.columns and len(named.columns) >= 2:
        named = named.toDF("product_key", "cost_price", *named.columns[2:])
    return named.selectExpr(
        f"{strip('product_key')} as product_key",
        f"try_cast(cost_price as {MONEY}) as cost_price",
    ).filter("length(product_key) > 0")


@dataclass(frozen=True)
class CostLookup:
    """The cost sheet with one row per key, and what was measured of it.

    A key listed twice makes every matching line count twice. ``copies`` and
    ``priced`` (listings with a cost) carry that weight, so sums over lines need no
    line to be repeated; ``cost_units`` is the sum of its costs.
    """

    weights: DataFrame
    fits: bool  # small enough to broadcast
    repeats: bool  # lists some key more than once


def cost_lookup(costs: DataFrame, max_bytes: int = BROADCAST_BYTES) -> CostLookup:
    """Group the sheet by key and measure it: one aggregate, one row to the driver."""
    weights = grouped(
        costs,
        ["product_key"],
        "count(1) as copies",
        "count(cost_price) as priced",
        f"{to_units(cast(total('cost_price'), MONEY))} as cost_units",
    )
    measured = weights.selectExpr(
        f"sum(octet_length(product_key) + {_ROW_BYTES}) as bytes", "max(copies) as copies"
    ).first()
    return CostLookup(
        weights,
        fits=(measured["bytes"] or 0) <= max_bytes,
        repeats=(measured["copies"] or 0) > 1,
    )


def _last_per_name(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Later rows of a sheet overwrite earlier ones with the same name."""
    return grouped(rows, [key], *[f"max_by({value}, row_pos) as {value}" for value in values])


def _cells(rows: DataFrame) -> DataFrame:
    """Trimmed cells of the rows that have both a name and a value."""
    return rows.selectExpr(
        f"coalesce({strip('name')}, '') as name",
        f"coalesce({strip('amount')}, '') as text",
        "row_pos",
    ).filter("name <> '' and text <> ''")


def fixed_monthly_costs(rows: DataFrame) -> DataFrame:
    """Monthly overhead per name (name, amount), the sheet's own total left out."""
    parsed = (
        _cells(rows)
        .filter(f"lower(name) <> {quote(C.TOTAL_ROW_MARKER)}")
        .selectExpr("name", f"{parse_currency('text')} as amount", "row_pos")
    )
    return _last_per_name(parsed, "name", "amount")


_IS_FEE_ROW = f"contains(lower(name), {quote(C.FEE_ROW_MARKER)})"


def fee_rules(rows: DataFrame) -> DataFrame:
    """Fee rule per payment kind (method, rate, fixed)."""
    wallet = quote(C.WALLET_MARKER)
    parsed = (
        _cells(rows)
        .filter(_IS_FEE_ROW)
        .selectExpr(
            f"if(contains(lower(name), {wallet}), {wallet}, {quote(C.CARD_METHOD)}) as method",
            f"{fee_rate('text')} as rate",
            f"{fee_fixed('text')} as fixed",
            "row_pos",
        )
    )
    return _last_per_name(parsed, "method", "rate", "fixed")


def per_order_costs(rows: DataFrame) -> DataFrame:
    """Fixed cost per order and name (name, amount); rows that are no number drop out."""
    parsed = (
        _cells(rows)
        .filter(f"not {_IS_FEE_ROW}")
        .selectExpr("name", f"{parse_fixed_amount('text')} as amount", "row_pos")
        .filter("amount is not null")
    )
    return _last_per_name(parsed, "name", "amount")


def total_amount(costs: DataFrame) -> DataFrame:
    """The one-row total of a (name, amount) table."""
    return costs.selectExpr(f"{total('amount')} as total")
