"""Every operator and report wired to the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.functions.frames import grouped
from profitloom.functions.money import AMOUNT, as_double, cast, rounded
from profitloom.functions.text import parse_currency, parse_fixed_amount, strip
from profitloom.operators import lines as L
from profitloom.operators import orders as O
from profitloom.plans import checks, customers, digests, discounts, forecast, lists, onepass, pnl, products, records, trends
from profitloom.sources import fees, sheets
from profitloom.sources.aligned import AlignedTables, write_aligned
from profitloom.sources.orders import FIRST_LINE, read_orders
from profitloom.sources.quarantine import check_orders
from profitloom.sources.sink import lines_by_order, read_table, write_table
from profitloom.sources.tables import WALLET_END, WALLET_START, ShopTables
from profitloom.storage import new_folder
from profitloom.streaming import orders as S
from profitloom.streaming.store import OrderStore

Query = Callable[[SparkSession, str], DataFrame]
BATCHES = 8
WALLET_DAY = date(2024, 1, 15)
SCENARIO_FACTORS = (Decimal("0.8"), Decimal("1"), Decimal("1.25"))


# --- shared inputs ----------------------------------------------------------------


def _placed(shop: ShopTables, customer: bool = False) -> DataFrame:
    """Active orders without any amounts."""
    return L.active(O.with_lines(shop.headers(customer), shop.order_keys()), shop.cfg)


def _all_orders(shop: ShopTables, customer: bool = False) -> DataFrame:
    return O.order_table(shop.headers(customer), shop.lines(), shop.cfg, shop.cost_lookup())


def _all_orders_and_first_line(shop: ShopTables) -> DataFrame:
    return O.order_table(
        shop.headers(customer=True), shop.lines(), shop.cfg, shop.cost_lookup(), first_line=True
    )


def _earned(shop: ShopTables, customer: bool = False) -> DataFrame:
    """Active orders with revenue, cost and profit."""
    return L.active(_all_orders(shop, customer), shop.cfg)


def _wallet(shop: ShopTables) -> DataFrame:
    return fees.wallet_fee_summary(shop.wallet_ledger(), WALLET_START, WALLET_END)


def _with_fee(shop: ShopTables, orders: DataFrame) -> DataFrame:
    card_fees = fees.card_fees_by_order(shop.card_transactions())
    rules = sheets.fee_rules(shop.per_order_sheet())
    return O.with_txn_fee(orders, card_fees, _wallet(shop), rules, shop.cfg)


def _fixed(shop: ShopTables) -> DataFrame:
    return sheets.fixed_monthly_costs(shop.fixed_sheet())


def _per_order(shop: ShopTables) -> DataFrame:
    return sheets.per_order_costs(shop.per_order_sheet())


def _pnl(shop: ShopTables) -> DataFrame:
    return pnl.profit_and_loss(_with_fee(shop, _all_orders(shop)), _fixed(shop), _per_order(shop))


def _forecast(shop: ShopTables) -> DataFrame:
    orders = _with_fee(shop, _all_orders(shop))
    return pnl.year_forecast(orders, _fixed(shop), _per_order(shop), shop.cfg)


def _allocated(shop: ShopTables, customer: bool = False) -> DataFrame:
    return L.allocate(shop.headers(customer), shop.lines())


def _priced(shop: ShopTables) -> DataFrame:
    """Lines with revenue and VAT."""
    return L.vat_split(L.line_revenue(L.line_table(_allocated(shop))), shop.cfg)


def _lines(shop: ShopTables, customer: bool = False) -> DataFrame:
    return L.enriched_lines(L.line_table(_allocated(shop, customer)), shop.costs(), shop.cfg)


def _product_sums(shop: ShopTables) -> DataFrame:
    lines = L.active(_allocated(shop), shop.cfg)
    return products.product_sums(lines, shop.cost_lookup(), shop.cfg)


def _titles(shop: ShopTables) -> DataFrame:
    return products.by_title(_product_sums(shop))


# --- line and order tables as results -----------------------------------------------

_LINE_KEY = ["order_number", "product_id", "variant_id", "product_key"]


def _doubles(*names: str) -> list[str]:
    return [f"{as_double(name)} as {name}" for name in names]


def _line_fields(lines: DataFrame) -> DataFrame:
    """The line table's columns in output form."""
    return lines.selectExpr(
        "order_number",
        "order_id",
        "order_date",
        "order_created_at",
        "product_key",
        "product_title",
        "variant_title",
        "quantity",
        "discount_code",
        "currency",
        "financial_status",
        "fulfillment_status",
        "product_id",
        "variant_id",
        "payment_method",
        "city",
        "customer_email",
        *_doubles(
            "unit_price",
            "item_discount",
            "total_discount",
            "shipping_revenue",
            "order_discount_share",
        ),
    )


def _amounts(lines: DataFrame, *names: str) -> DataFrame:
    return lines.selectExpr(*_LINE_KEY, *rounded(*names))


def line_items(shop: ShopTables) -> DataFrame:
    return _line_fields(L.line_table(_allocated(shop, customer=True)))


def line_items_nested(shop: ShopTables) -> DataFrame:
    """The same from order documents."""
    return _line_fields(L.line_items(shop.documents(), shop.cfg))


def orders_source(shop: ShopTables) -> DataFrame:
    """The landed documents as read, one row per order."""
    first = shop.documents().filter(f"{FIRST_LINE} = 0")
    return first.selectExpr(
        "order_number",
        "id as order_id",
        "created_at",
        "financial_status",
        "cast(total_discounts as double) as total_discounts",
        "n_lines",
    )


def orders_quarantine(shop: ShopTables) -> DataFrame:
    """What a check of the feed counts, with some documents damaged on their way here."""
    number = "cast(get_json_object(value, '$.order_number') as bigint)"
    damaged = (
        f"case when {number} % 97 = 0 then left(value, length(value) div 2) "
        f"when {number} % 89 = 1 then regexp_replace(value, '\"total_discounts\":\"[^\"]*\"', '\"total_discounts\":\"12,5x\"') "
        f"when {number} % 83 = 2 then regexp_replace(value, '\"created_at\":\"[0-9]{{4}}', '\"created_at\":\"year') "
        f"when {number} % 79 = 3 then concat(left(value, length(value) - 1), ',\"loyalty_tier\":\"gold\"}}') else value end as value"
    )
    landed = new_folder(shop.spark, "damaged-feed")
    feed = shop.spark.read.option("recursiveFileLookup", True).text(shop.document_feed())
    feed.selectExpr(damaged).write.option("compression", "gzip").text(landed)
    return check_orders(shop.spark, landed, new_folder(shop.spark, "checked-orders")).counts()


def order_fields(shop: ShopTables) -> DataFrame:
    """Order-level fields taken from each document."""
    docs = L.order_headers(shop.documents(), shop.cfg, "items_value")
    return L.order_rows(docs).selectExpr(
        "order_number",
        "order_id",
        "order_date",
        "order_created_at",
        "currency",
        "financial_status",
        "fulfillment_status",
        "customer_email",
        "payment_method",
        "city",
        "discount_code",
        *_doubles("order_shipping", "undistributed_discount", "items_value"),
    )


def order_level(shop: ShopTables) -> DataFrame:
    active = L.active(_lines(shop), shop.cfg)
    return O.order_level(active, shop.cfg).selectExpr(
        "order_number", "order_id", "payment_method", *rounded("revenue", "revenue_excl_mva")
    )


_TOTALS = ["revenue_excl_mva", "total_cost", "total_discount", "shipping_revenue"]


def order_totals(shop: ShopTables) -> DataFrame:
    totals = O.order_totals(L.active(_lines(shop, customer=True), shop.cfg))
    return totals.selectExpr(
        "order_number", "order_date", "discount_code", "customer_email", *rounded(*_TOTALS)
    )


def order_table(shop: ShopTables) -> DataFrame:
    return _all_orders_and_first_line(shop).selectExpr(
        "order_number",
        "order_date",
        "is_refunded",
        "discount_code",
        "customer_email",
        "n_lines",
        "unpriced_lines",
        *rounded(*_TOTALS, "profit", "first_line_discount"),
    )


def actual_fee_lookup(shop: ShopTables) -> DataFrame:
    card_fees = fees.card_fees_by_order(shop.card_transactions())
    return O.with_actual_fee(_placed(shop), card_fees).selectExpr(
        "order_number", "order_id", *rounded("actual_fee")
    )


def txn_fee(shop: ShopTables) -> DataFrame:
    return _with_fee(shop, _earned(shop)).selectExpr(
        "order_number", "payment_method", *rounded("txn_fee")
    )


# --- sources ------------------------------------------------------------------------


def card_fees_by_order(shop: ShopTables) -> DataFrame:
    return fees.card_fees_by_order(shop.card_transactions()).selectExpr(
        "order_id", *rounded("actual_fee")
    )


def wallet_fee_summary(shop: ShopTables) -> DataFrame:
    return _wallet(shop).selectExpr(
        "total_fees", "total_captured", *_doubles("avg_rate"), "num_transactions"
    )


def wallet_fee_default_window(shop: ShopTables) -> DataFrame:
    """The wallet summary over the default window before a given day."""
    start, end = fees.wallet_window(replace(shop.cfg, as_of=WALLET_DAY))
    return fees.wallet_fee_summary(shop.wallet_ledger(), start, end).selectExpr(
        "total_fees", "total_captured", *_doubles("avg_rate"), "num_transactions"
    )


def _named_amounts(costs: DataFrame) -> DataFrame:
    return costs.selectExpr("name", *_doubles("amount"))


def product_costs(shop: ShopTables) -> DataFrame:
    return shop.costs().selectExpr("product_key", *_doubles("cost_price"))


def _parsed(rows: DataFrame, parse: Callable[[str], str]) -> DataFrame:
    cell = f"coalesce({strip('amount')}, '')"
    return rows.selectExpr("row_pos", f"{as_double(parse(cell))} as amount")


def fee_rules(shop: ShopTables) -> DataFrame:
    return sheets.fee_rules(shop.per_order_sheet()).selectExpr(
        "method", *_doubles("rate", "fixed")
    )


def _sheet_total(costs: DataFrame) -> DataFrame:
    return sheets.total_amount(costs).selectExpr(*rounded("total"))


def sink_tables(shop: ShopTables) -> DataFrame:
    """Write line and order tables, then report from the files alone."""
    line_path = new_folder(shop.spark, "lines")
    order_path = new_folder(shop.spark, "orders")
    costs, fits = shop.costs(), shop.cost_lookup().fits

    def enriched(allocated: DataFrame) -> DataFrame:
        return L.enriched_lines(L.line_table(allocated), F.broadcast(costs) if fits else costs, shop.cfg)

    # Both tables are made of the same stored lines, which meet their products and are dealt by order once.
    folder = new_folder(shop.spark, "lines-by-order")
    with lines_by_order(shop.headers(), shop.lines(), shop.order_keys(), folder) as pairs:
        allocated = reduce(DataFrame.unionByName, [L.allocate(headers, lines) for headers, lines in pairs])
        # With a cost sheet that fits, lines travel without costs and amounts.
        lines = allocated if fits else enriched(allocated)
        write_table(lines, line_path, "order_number", "line_pos", shape=enriched if fits else None)
        tables = [O.order_table(headers, lines, shop.cfg, shop.cost_lookup()) for headers, lines in pairs]
        write_table(reduce(DataFrame.unionByName, tables), order_path, "order_number")
    orders = L.active(read_table(shop.spark, order_path), shop.cfg)
    lines = L.active(read_table(shop.spark, line_path), shop.cfg)
    per_week = grouped(lines, [trends.WEEK], "count(1) as n_lines")
    return trends.weekly_profit(orders).join(per_week, "week")


def _aligned(shop: ShopTables) -> AlignedTables:
    card_fees = fees.card_fees_by_order(shop.card_transactions())
    folder = new_folder(shop.spark, "aligned")
    return write_aligned(shop.headers(True), shop.lines(), card_fees, shop.cfg, shop.cost_lookup(), folder)


def line_items_aligned(shop: ShopTables) -> DataFrame:
    """The line table from lines and order pages that lie in the same buckets."""
    return _line_fields(L.line_table(_aligned(shop).allocated()))


def txn_fee_aligned(shop: ShopTables) -> DataFrame:
    """Fees per order from orders and charges that lie in the same buckets."""
    rules = sheets.fee_rules(shop.per_order_sheet())
    orders = L.active(_aligned(shop).with_fee(_wallet(shop), rules, shop.cfg), shop.cfg)
    return orders.selectExpr("order_number", "payment_method", *rounded("txn_fee"))


def forecast_by_day(shop: ShopTables) -> DataFrame:
    """The forecast as of every day with orders; refunds are booked after the orders, as changes."""
    orders = _with_fee(shop, _all_orders(shop))
    days = forecast.DaySums(shop.spark, new_folder(shop.spark, "day-sums"))
    placed = orders.withColumn("is_refunded", F.lit(False))
    days.book(forecast.day_sums(placed), 0)
    refunded = orders.filter("is_refunded")
    days.book(forecast.day_changes(refunded.withColumn("is_refunded", F.lit(False)), refunded), 1)
    return forecast.forecast_by_day(days.days(), _fixed(shop), _per_order(shop))


def one_pass_reports(shop: ShopTables) -> DataFrame:
    """The sums behind six reports in one table, a row per week, day, method, city and code."""
    sums = onepass.report_sums(L.active(_all_orders_and_first_line(shop), shop.cfg))
    key = f"coalesce({', '.join(f'cast({c} as string)' for c in onepass.SETS)}) as key"
    return sums.selectExpr("report", key, "orders", *rounded(*onepass.SUMS[:-1]))


def order_differences(shop: ShopTables) -> DataFrame:
    """Orders that differ between the stored order table and the one made anew, with some altered on disk."""
    made = _all_orders(shop)
    columns = ["order_date", "financial_status", "n_lines", "revenue_excl_mva", "total_cost"]
    path = new_folder(shop.spark, "orders")
    altered = made.filter("order_number % 997 <> 5").withColumn(
        "n_lines", F.expr("if(order_number % 499 = 3, n_lines + 1, n_lines)")
    )
    write_table(altered, path, "order_number")
    stored = read_table(shop.spark, path)
    ranges = digests.differing_ranges(*(digests.build_tree(t, "order_number", columns) for t in (made, stored)))
    found = digests.differing_rows(made, stored, ranges, "order_number", columns)
    return found.selectExpr("key as order_number", "difference")


# --- streaming ----------------------------------------------------------------------


def _files_per_batch(shop: ShopTables) -> int:
    """Files of the feed in one micro-batch, so that a run takes about ``BATCHES``."""
    files = len(read_orders(shop.spark, shop.document_feed()).inputFiles())
    return max(1, -(-files // BATCHES))


def incremental_orders(shop: ShopTables) -> DataFrame:
    """Weekly profit from the table kept up to date by the order feed."""
    store = OrderStore(shop.spark, new_folder(shop.spark, "orders"))
    progress = new_folder(shop.spark, "order-progress")
    # Merged midway; the batches after that are read on top, as between two refreshes.
    S.store_orders(shop.spark, shop.document_feed(), store, progress, _files_per_batch(shop), refresh_every=5)
    docs = L.order_headers(store.read(), shop.cfg)
    orders = O.order_table(L.order_rows(docs), L.raw_lines(docs), shop.cfg, shop.cost_lookup())
    return trends.weekly_profit(L.active(orders, shop.cfg))


def _booked_sales(shop: ShopTables, period: str) -> str:
    """Table of sales booked from the whole feed, with every state an order went through."""
    table = new_folder(shop.spark, "sales")
    S.stream_sales(
        shop.spark,
        shop.document_feed(),
        table,
        new_folder(shop.spark, "sales-progress"),
        shop.cfg,
        period,
        _files_per_batch(shop),
    )
    return table


def _streaming_sales(shop: ShopTables, period: str) -> DataFrame:
    return S.current_sales(shop.spark, _booked_sales(shop, period)).selectExpr(
        "period_start", "orders", *rounded("revenue", "revenue_excl_mva")
    )


def streaming_final_sales(shop: ShopTables) -> DataFrame:
    """Weekly figures, those published when the week was over plus their corrections, and whether it is."""
    table = _booked_sales(shop, S.WEEK)
    S.finalize_sales(shop.spark, table, new_folder(shop.spark, "final-progress"), S.WEEK, "14 days")
    sums = ("revenue", "revenue_excl_mva")
    whole = [f"if(is_final, {cast(f'final_{c} + corrected_{c}', AMOUNT)}, {c}) as {c}" for c in sums]
    found = S.final_sales(shop.spark, table).filter("orders <> 0").selectExpr("period_start", "is_final", "orders", *whole)
    return found.selectExpr("period_start", "is_final", "orders", *rounded(*sums))


def streaming_records(shop: ShopTables) -> DataFrame:
    """Records and customer counts kept up to date by the feed, refunds taken off again."""
    table = new_folder(shop.spark, "records")
    progress = new_folder(shop.spark, "records-progress")
    S.stream_records(shop.spark, shop.document_feed(), table, progress, shop.cfg, _files_per_batch(shop))
    totals = S.order_records(shop.spark, table)
    wanted = ("day_revenue_excl_mva", "day_orders", "week_revenue_excl_mva", "week_orders", "order_revenue_excl_mva",
              "customer_orders", "weekday_orders", "hour_orders")
    records = S.current_records(totals).filter(F.col("record").isin(*wanted))
    counts = S.customer_frequency(totals).selectExpr("'customers' as record", "cast(orders as string) as key", "customers as value")
    return records.selectExpr("record", "key", *rounded("value")).unionByName(
        counts.selectExpr("record", "key", f"{as_double('value')} as value")
    )


# --- the catalogue --------------------------------------------------------------------


def _margin_lines(shop: ShopTables) -> DataFrame:
    return _lines(shop).selectExpr(*_LINE_KEY, *rounded("total_cost", "profit"), "margin_pct")


def _shop_queries() -> dict[str, Callable[[ShopTables], DataFrame]]:
    rate = lambda s: O.wallet_rate(_wallet(s), s.cfg)
    ship = lambda s: discounts.shipping_cost_per_order(_per_order(s))
    return {
        # sources and sink
        "orders_source": orders_source,
        "orders_quarantine": orders_quarantine,
        "card_fees_by_order": card_fees_by_order,
        "wallet_fee_summary": wallet_fee_summary,
        "wallet_fee_default_window": wallet_fee_default_window,
        "product_costs": product_costs,
        "fixed_monthly_costs": lambda s: _named_amounts(_fixed(s)),
        "fixed_monthly_total": lambda s: _sheet_total(_fixed(s)),
        "parse_currency": lambda s: _parsed(s.fixed_sheet(), parse_currency),
        "per_order_costs": lambda s: _named_amounts(_per_order(s)),
        "per_order_total": lambda s: _sheet_total(_per_order(s)),
        "parse_fee_rule": fee_rules,
        "parse_fixed_amount": lambda s: _parsed(s.per_order_sheet(), parse_fixed_amount),
        "sink_tables": sink_tables,
        "line_items_aligned": line_items_aligned,
        "txn_fee_aligned": txn_fee_aligned,
        # lines
        "line_items": line_items,
        "line_items_nested": line_items_nested,
        "order_fields": order_fields,
        "line_revenue": lambda s: _amounts(
            L.line_revenue(L.line_table(_allocated(s))), "item_revenue", "revenue"
        ),
        "vat_split": lambda s: _amounts(
            _priced(s), "revenue_excl_mva", "mva_collected", "shipping_revenue_excl_mva"
        ),
        "cost_join": lambda s: L.cost_join(s.lines(), s.costs()).selectExpr(
            *_LINE_KEY, *_doubles("cost_price")
        ),
        "line_profit": _margin_lines,
        "refund_flag": lambda s: L.with_refund_flag(
            O.with_lines(s.headers(), s.order_keys()), s.cfg
        ).select("order_number", "financial_status", "is_refunded"),
        "active_lines": lambda s: _amounts(L.active(_priced(s), s.cfg), "revenue_excl_mva"),
        # orders
        "order_level": order_level,
        "actual_fee_lookup": actual_fee_lookup,
        "txn_fee": txn_fee,
        "order_totals": order_totals,
        "order_table": order_table,
        # profit and loss
        "headline_totals": lambda s: pnl.headline_totals(_all_orders(s)),
        "overhead_for_period": lambda s: pnl.overhead_for_period(
            _placed(s).withColumn("is_refunded", F.lit(False)), _fixed(s)
        ),
        "net_result": lambda s: pnl.net_result(_pnl(s)),
        "fee_breakdown": lambda s: pnl.fee_breakdown(_with_fee(s, _earned(s)), rate(s)),
        "overall_fee_rate": lambda s: pnl.overall_fee_rate(_with_fee(s, _earned(s))),
        "pnl_statement": lambda s: pnl.pnl_statement(_pnl(s), s.cfg),
        "fixed_cost_table": lambda s: pnl.fixed_cost_table(_fixed(s)),
        "order_cost_table": lambda s: pnl.order_cost_table(
            _per_order(s), _placed(s).withColumn("is_refunded", F.lit(False))
        ),
        "unmatched_products": lambda s: products.unmatched_products(_product_sums(s)),
        "unmatched_headline": lambda s: products.unmatched_headline(_product_sums(s)),
        "year_forecast": lambda s: pnl.forecast_figures(_forecast(s)),
        "forecast_by_day": forecast_by_day,
        "forecast_statement": lambda s: pnl.forecast_statement(_forecast(s)),
        "break_even": lambda s: pnl.break_even(_pnl(s)),
        "price_scenario": lambda s: pnl.price_scenario(s.price_list(), SCENARIO_FACTORS, s.cfg),
        # several reports at once
        "one_pass_reports": one_pass_reports,
        # time
        "weekly_profit": lambda s: trends.weekly_profit(_earned(s)),
        "overall_aov": lambda s: trends.overall_aov(_earned(s)),
        "weekly_aov": lambda s: trends.weekly_aov(_earned(s)),
        "daily_orders": lambda s: trends.daily_orders(_placed(s)),
        "orders_per_day": lambda s: trends.orders_per_day(_placed(s)),
        "weekday_pattern": lambda s: trends.weekday_pattern(_placed(s)),
        "hour_pattern": lambda s: trends.hour_pattern(_placed(s)),
        "peak_times": lambda s: trends.peak_times(_placed(s)),
        "weekly_shipping": lambda s: trends.weekly_shipping(_earned(s), ship(s)),
        # products
        "top_products_profit": lambda s: products.top_products_profit(_titles(s), s.cfg),
        "product_margin": lambda s: products.product_margin(_titles(s)),
        "best_sellers": lambda s: products.best_sellers(_titles(s), s.cfg),
        "contribution_margin": lambda s: products.contribution_margin(_titles(s), s.cfg),
        # customers, payment, place
        "repeat_customers": lambda s: customers.repeat_customers(_placed(s, True)),
        "order_frequency": lambda s: customers.order_frequency(_placed(s, True)),
        "payment_summary": lambda s: customers.payment_summary(_earned(s)),
        "city_top": lambda s: customers.city_top(_earned(s, True), s.cfg),
        # discounts and shipping
        "discount_usage": lambda s: discounts.discount_usage(
            L.active(_all_orders_and_first_line(s), s.cfg)
        ),
        "discount_profitability": lambda s: discounts.discount_profitability(_earned(s, True)),
        "discount_baseline": lambda s: discounts.discount_baseline(_earned(s, True)),
        "shipping_result": lambda s: discounts.shipping_result(_earned(s), ship(s)),
        # records
        "best_day": lambda s: records.best_day(_earned(s)),
        "best_week": lambda s: records.best_week(_earned(s)),
        "best_product": lambda s: products.best_product(_titles(s)),
        "biggest_order": lambda s: records.biggest_order(_earned(s)),
        "best_customer": lambda s: records.best_customer(_earned(s, True)),
        # lists
        "unfulfilled_count": lambda s: lists.unfulfilled_count(_placed(s)),
        "unfulfilled_orders": lambda s: lists.unfulfilled_orders(
            _earned(s, True), s.lines(), s.cost_lookup()
        ),
        "orders_summary": lambda s: lists.orders_summary(_earned(s)),
        "line_detail": lambda s: lists.line_detail(L.active(_lines(s), s.cfg)),
        # checks
        "cost_coverage": lambda s: checks.cost_coverage(_earned(s)),
        "duplicate_cost_keys": lambda s: checks.duplicate_cost_keys(s.costs()),
        "order_differences": order_differences,
        "reconciliation": lambda s: checks.reconciliation(_all_orders(s)),
        "allocation_check": lambda s: checks.allocation_check(_allocated(s), s.headers()),
        # streaming
        "incremental_orders": incremental_orders,
        "streaming_daily_sales": lambda s: _streaming_sales(s, S.DAY),
        "streaming_weekly_sales": lambda s: _streaming_sales(s, S.WEEK),
        "streaming_final_sales": streaming_final_sales,
        "streaming_records": streaming_records,
    }


def _on_tables(build: Callable[[ShopTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(ShopTables(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    return {name: _on_tables(build) for name, build in _shop_queries().items()}
