"""Order documents to priced, costed lines.

Two inputs lead to the same lines: pages of nested order documents, which meet their
order's sums and are flattened row by row without a shuffle, and flat header and line tables, joined on
the order. Until a line table is asked for, amounts are whole-number units (see functions.money).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
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
    margin_pct,
    quote,
    sum_units,
    to_units,
    without_vat,
)
from profitloom.functions.time import wall_date
from profitloom.operators.skew import left_join_lookup
from profitloom.sources.orders import FIRST_LINE, VERSION
from profitloom.sources.sheets import BROADCAST_BYTES, CostLookup

SUM_TYPE = "decimal(28,4)"
VALUE_UNITS = "price_units * quantity"


def text_money(x: str) -> str:
    return cast(f"coalesce({x}, '0')", MONEY)


def _sum_of(array: str, value: str) -> str:
    """Sum of an expression over the items ``x`` of an array; a missing array sums to 0."""
    zero = f"cast(0 as {SUM_TYPE})"
    return f"coalesce(aggregate({array}, {zero}, (acc, x) -> cast(acc + {value} as {SUM_TYPE})), 0)"


def discount_code(code: str) -> str:
    """An order's own code, or the label for none."""
    return f"coalesce({code}, {quote(C.NO_DISCOUNT)})"


def override_table(spark: SparkSession, cfg: ProfitConfig) -> DataFrame | None:
    """The shop's code overrides (order_number, override), one row per order."""
    rows = [(int(number), code) for number, code in cfg.discount_code_overrides.items()]
    return spark.createDataFrame(rows, "order_number bigint, override string") if rows else None


def with_overrides(
    orders: DataFrame, overrides: DataFrame | None, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Orders credited with the code set for them, if there is one; broadcast once measured."""
    if overrides is None:
        return orders
    size = overrides.selectExpr("sum(octet_length(override) + 32) as bytes").first()["bytes"] or 0
    listed = F.broadcast(overrides) if size <= max_bytes else overrides
    code = "coalesce(override, discount_code) as discount_code"
    columns = [code if c == "discount_code" else c for c in orders.columns]
    return orders.join(listed, "order_number", "left").selectExpr(*columns)


def is_refunded(cfg: ProfitConfig) -> str:
    listed = ", ".join(quote(status) for status in cfg.refunded_statuses)
    return f"financial_status in ({listed})"


def active(df: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Rows of orders that were not refunded."""
    return df.filter(f"not ({is_refunded(cfg)})")


# --- nested order documents ---------------------------------------------------

# Sums over one page's lines.
DOCUMENT_DISCOUNTS = _sum_of("line_items", text_money("x.total_discount"))
DOCUMENT_ITEMS_VALUE = _sum_of(
    "line_items", cast(f"{text_money('x.price')} * coalesce(x.quantity, 0)", MONEY)
)
DOCUMENT_SHIPPING = cast(_sum_of("shipping_lines", text_money("x.price")), MONEY)


# The same sums by name.
PAGE_SUMS = {
    "n_lines": "cast(coalesce(size(line_items), 0) as bigint)",
    "items_value": DOCUMENT_ITEMS_VALUE,
    "own_discount": DOCUMENT_DISCOUNTS,
}
_OWN_SUMS = [f"{value} as {name}" for name, value in PAGE_SUMS.items()]


def with_order_sums(docs: DataFrame) -> DataFrame:
    """Pages with their order's ``n_lines``, ``items_value`` and ``own_discount``, summed over all
    pages of the version before they meet a page."""
    pages = docs.selectExpr("*", f"{VERSION} as version")
    sums = grouped(
        pages.selectExpr("id", "version", *_OWN_SUMS),
        ["id", "version"],
        "sum(n_lines) as n_lines",
        f"{cast('sum(items_value)', SUM_TYPE)} as items_value",
        f"{cast('sum(own_discount)', SUM_TYPE)} as own_discount",
    )
    # A document without an id is an order by itself.
    return pages.join(sums, ["id", "version"], "left").selectExpr(
        *docs.columns, *[f"coalesce({name}, {value}) as {name}" for name, value in PAGE_SUMS.items()]
    )


def current_pages(docs: DataFrame) -> DataFrame:
    """The pages of every order's newest version with the order's sums, as ``newest_orders`` and
    ``with_order_sums`` give them, from one narrow and one wide pass over the documents.

    Version and sums are settled on narrow columns, first per version, then per order, so a huge order
    is summed by many tasks; its pages then meet one row. That side is the hashed one, so that no page is
    sorted, and pages travel without their lines where nobody asks for them. A document without an id is
    an order by itself.
    """
    alone = [f"if(id is null, {value}, null) as _{name}" for name, value in PAGE_SUMS.items()]
    keyed = docs.selectExpr("*", f"{VERSION} as _version", *alone)
    versions = grouped(
        keyed.filter("id is not null").selectExpr("id", "_version", *_OWN_SUMS),
        ["id", "_version"],
        "sum(n_lines) as n_lines",
        f"{cast('sum(items_value)', SUM_TYPE)} as items_value",
        f"{cast('sum(own_discount)', SUM_TYPE)} as own_discount",
    )
    best = grouped(
        versions, ["id"], *[f"max_by({name}, _version) as {name}" for name in PAGE_SUMS], "max(_version) as _best"
    )
    pages = keyed.join(best.hint("shuffle_hash"), "id", "left").filter("id is null or _version = _best")
    return pages.selectExpr(*docs.columns, *[f"coalesce({name}, _{name}) as {name}" for name in PAGE_SUMS])


def order_headers(docs: DataFrame, cfg: ProfitConfig, *keep: str) -> DataFrame:
    """One row per page: order fields, shipping and discount left to allocate.

    Pages come from ``with_order_sums``; without its sums every document is an order by
    itself, and no shuffle is needed. ``keep`` names further fields or sums to pass on.
    """
    summed = docs if "own_discount" in docs.columns else docs.selectExpr("*", *_OWN_SUMS)
    unknown = quote(C.UNKNOWN)
    left_over = f"greatest(0, {text_money('total_discounts')} - own_discount)"
    headers = summed.selectExpr(
        *keep,
        "order_number",
        "id as order_id",
        f"{wall_date('created_at')} as order_date",
        "created_at as order_created_at",
        "currency",
        "coalesce(financial_status, '') as financial_status",
        f"coalesce(nullif(fulfillment_status, ''), {quote(C.UNFULFILLED)}) as fulfillment_status",
        "email as customer_email",
        f"coalesce(get(payment_gateway_names, 0), {unknown}) as payment_method",
        "coalesce(nullif(shipping_address.city, ''), nullif(billing_address.city, ''), "
        f"{unknown}) as city",
        f"{discount_code('get(discount_codes, 0).code')} as discount_code",
        f"{DOCUMENT_SHIPPING} as order_shipping",
        f"{cast(left_over, MONEY)} as undistributed_discount",
        f"{FIRST_LINE} as first_line",
        "line_items",
    )
    return with_overrides(headers, override_table(docs.sparkSession, cfg))


def order_rows(headers: DataFrame) -> DataFrame:
    """One row per order: its first page, without lines."""
    return headers.filter("first_line = 0").drop("first_line", "line_items")


def product_key(title: str, variant: str) -> str:
    """Name under which the cost sheet lists a product."""
    return f"case when {variant} <> '' then concat_ws(' ', {title}, {variant}) else {title} end"


def raw_lines(headers: DataFrame, *keep: str) -> DataFrame:
    """One row per line of each page; ``line_pos`` is the line's place in its order."""
    opened = headers.selectExpr(
        "order_number", *keep, "first_line as page_start", "posexplode(line_items) as (page_pos, li)"
    )
    title = "coalesce(li.title, '')"
    return opened.selectExpr(
        "order_number",
        *keep,
        "page_start + page_pos as line_pos",
        f"{product_key(title, 'li.variant_title')} as product_key",
        f"{title} as product_title",
        "li.variant_title as variant_title",
        "coalesce(li.quantity, 0) as quantity",
        f"{to_units(text_money('li.price'))} as price_units",
        f"{to_units(text_money('li.total_discount'))} as discount_units",
        "li.product_id as product_id",
        "li.variant_id as variant_id",
    )


def allocate_documents(docs: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Lines of documents with allocated discount and shipping; a page that has its order's sums meets
    no other row."""
    headers = order_headers(docs, cfg, "items_value")
    fields = [c for c in headers.columns if c not in ("order_number", "line_items")]
    return _allocated(raw_lines(headers, *fields), "line_pos = 0")


# --- flat header and line tables ----------------------------------------------


def allocate(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Flat headers and lines to the same allocated lines.

    The order's item value and first line come from an aggregate that combines
    before the shuffle, joined back to the lines. Unlike a window over the order,
    neither step needs all lines of an order in a single task: adaptive execution
    splits the lines of a huge order over several tasks of the join.
    """
    per_order = grouped(
        lines,
        ["order_number"],
        f"{sum_units(VALUE_UNITS)} as items_value",
        "min(line_pos) as first_pos",
    )
    orders = headers.join(per_order, "order_number")
    joined = lines.join(orders, "order_number")
    return _allocated(joined, "line_pos = first_pos").drop("first_pos")


# --- shared steps ---------------------------------------------------------------


def share_units(value: str) -> str:
    """Part of the order's left-over discount that falls on ``value`` (an amount as
    double) worth of its items, in units of 1e-9."""
    part = f"cast(undistributed_discount as double) * ({value} / nullif(cast(items_value as double), 0d))"
    return (
        "case when undistributed_discount > 0 and items_value > 0 "
        f"then cast(rint({part} * {float(10**SHARE_UNITS)}d) as bigint) else 0L end"
    )


def _allocated(lines: DataFrame, is_first: str) -> DataFrame:
    shipping = to_units("order_shipping")
    return lines.selectExpr(
        "*",
        f"{VALUE_UNITS} as value_units",
        f"{share_units(f'({VALUE_UNITS}) / 10000d')} as share_units",
        f"case when {is_first} and order_shipping > 0 then {shipping} else 0L end"
        " as shipping_units",
    ).drop("order_shipping", "undistributed_discount", "items_value")


def line_table(allocated: DataFrame) -> DataFrame:
    """Allocated lines with their amounts as decimals."""
    return allocated.selectExpr(
        "*",
        f"{from_units('price_units')} as unit_price",
        f"{from_units('discount_units')} as item_discount",
        f"{from_units('share_units', SHARE_UNITS, SHARE)} as order_discount_share",
        f"{from_units('shipping_units')} as shipping_revenue",
        "item_discount + order_discount_share as total_discount",
    ).drop("price_units", "discount_units", "value_units", "share_units", "shipping_units")


def line_items(docs: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Documents to the line table."""
    return line_table(allocate_documents(docs, cfg))


def line_revenue(lines: DataFrame) -> DataFrame:
    """Item revenue, and revenue with shipping."""
    items = f"{cast('unit_price * quantity', MONEY)} - total_discount"
    return lines.selectExpr(
        "*",
        f"{cast(items, AMOUNT)} as item_revenue",
        f"{cast('item_revenue + shipping_revenue', AMOUNT)} as revenue",
    )


def vat_split(lines: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """Revenue and shipping without VAT, and the VAT itself."""
    return lines.selectExpr(
        "*",
        f"{without_vat('revenue', cfg.vat_rate)} as revenue_excl_mva",
        f"{without_vat('shipping_revenue', cfg.vat_rate)} as shipping_revenue_excl_mva",
        f"{cast('revenue - revenue_excl_mva', AMOUNT)} as mva_collected",
    )


def cost_join(lines: DataFrame, costs: DataFrame, dedupe: bool = False) -> DataFrame:
    """Add the unit cost by product key, keeping lines that have none.

    No hint: the sheet is broadcast when its file is below the session's limit, and
    otherwise joined by key with adaptive skew handling. A key listed twice repeats
    its lines unless ``dedupe`` keeps the lowest cost per key.
    """
    costs = costs.select("product_key", "cost_price")
    if dedupe:
        costs = grouped(costs, ["product_key"], "min(cost_price) as cost_price")
    return lines.join(costs, "product_key", "left")


def weigh_lines(lines: DataFrame, costs: CostLookup) -> DataFrame:
    """Add cost units and listing counts by product key, without repeating any line."""
    spread = "order_number, line_pos"
    weighed = left_join_lookup(lines, costs.weights, "product_key", spread, costs.fits)
    return weighed.selectExpr(
        *lines.columns,
        "coalesce(copies, 1L) as copies",
        "coalesce(priced, 0L) as priced",
        "coalesce(cost_units, 0L) as cost_units",
    )


def line_profit(lines: DataFrame) -> DataFrame:
    """Cost, profit and margin of each line; missing where the cost is."""
    return lines.selectExpr(
        "*",
        f"{cast('cost_price * quantity', AMOUNT)} as total_cost",
        f"{cast('revenue_excl_mva - total_cost', AMOUNT)} as profit",
        f"{margin_pct('profit', 'revenue_excl_mva')} as margin_pct",
    )


def with_refund_flag(lines: DataFrame, cfg: ProfitConfig) -> DataFrame:
    return lines.selectExpr("*", f"{is_refunded(cfg)} as is_refunded")


def enriched_lines(
    lines: DataFrame, costs: DataFrame, cfg: ProfitConfig, dedupe_costs: bool = False
) -> DataFrame:
    """The full line table: revenue, VAT, cost, profit and refund flag."""
    priced = vat_split(line_revenue(lines), cfg)
    costed = line_profit(cost_join(priced, costs, dedupe_costs))
    return with_refund_flag(costed, cfg)
