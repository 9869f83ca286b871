"""Incremental orders and running sales."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profitloom.config import ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import AMOUNT, MONEY, cast, quote, without_vat
from profitloom.functions.time import wall_date, wall_hour, week_start
from profitloom.operators.lines import (
    DOCUMENT_DISCOUNTS,
    DOCUMENT_ITEMS_VALUE,
    DOCUMENT_SHIPPING,
    is_refunded,
    text_money,
)
from profitloom.schemas import ORDER
from profitloom.sources.orders import FIRST_LINE, VERSION, newest_orders, stream_orders
from profitloom.storage import new_folder
from profitloom.streaming.buckets import SPAN, BucketLog
from profitloom.streaming.keyed import KEEP, KeyedTotals
from profitloom.streaming.log import batch_writer, latest, newest, read_log
from profitloom.streaming.store import OrderStore


def _run(frame: DataFrame, write, checkpoint: str) -> None:
    """Process what has landed since the last run, then stop."""
    query = (
        frame.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_orders(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Take in the order files that are new since the last run, then stop.

    Each batch keeps the newest version of every page it holds; reading tells which pages
    are of an order's newest version.
    """
    latest = lambda batch: newest(batch, ["id", "first_line"], F.expr(VERSION))
    _run(stream_orders(spark, source, files_per_batch), batch_writer(table, latest), checkpoint)


@dataclass(frozen=True)
class Compacted:
    """Current orders as of batch ``upto``."""

    path: str
    upto: int


def _versions(spark: SparkSession, table: str, base: Compacted | None) -> DataFrame:
    """The compacted table and the batches after it, or all batches."""
    batches = read_log(spark, table, ORDER)
    if base is None:
        return batches
    old = spark.read.schema(ORDER).parquet(base.path).selectExpr("*", "-1L as batch")
    return old.unionByName(batches.filter(f"batch > {base.upto}"))


def current_orders(
    spark: SparkSession, table: str, base: Compacted | None = None
) -> DataFrame:
    """The pages of the newest version of every order taken in so far.

    Versions are told apart by the instant of their change; of a page that came again in
    the same version the later batch counts. With a compacted ``base`` only later batches
    are read besides it.
    """
    latest = newest_orders(_versions(spark, table, base))
    return newest_orders(latest, "batch", FIRST_LINE).select(*ORDER.fieldNames())


def compact_orders(spark: SparkSession, table: str, base: Compacted | None = None) -> Compacted:
    """Write the current orders to a table that later batches are read on top of."""
    target = new_folder(spark, "orders-compacted")
    upto = read_log(spark, table, ORDER).agg(F.max("batch")).first()[0]
    current_orders(spark, table, base).write.parquet(target)
    return Compacted(target, -1 if upto is None else upto)


def store_orders(
    spark: SparkSession,
    source: str,
    store: OrderStore,
    checkpoint: str,
    files_per_batch: int | None = None,
    refresh_every: int = 4,
) -> None:
    """Take the order files that are new into a store, then stop.

    The store's table is refreshed after every so many batches; a refresh writes only the buckets that
    these batches touch, and what came after it is read on top.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)
        if (batch_id + 1) % refresh_every == 0:
            store.refresh()

    _run(stream_orders(spark, source, files_per_batch), write, checkpoint)


DAY, WEEK = "1 day", "7 days"


def _sales_schema() -> StructType:
    schema = StructType().add("period_start", "date")
    for name, kind in _SUMS.items():
        schema = schema.add(name, kind)
    return schema


_SUMS = {"orders": "long", "revenue": AMOUNT, "revenue_excl_mva": AMOUNT}


def _summed(factor: str = "", **names: str) -> list[str]:
    """Sums of the sales columns, each times ``factor``."""
    return [f"{cast(f'sum({factor}{c})', t)} as {names.get(c, c)}" for c, t in _SUMS.items()]


def page_sales(docs: DataFrame, cfg: ProfitConfig, period: str, *also: str) -> DataFrame:
    """What each page adds to its order's version, and the order's fields; ``also`` are further ones."""
    start = wall_date("created_at")
    return docs.selectExpr(
        *also,
        "id",
        f"{VERSION} as version",
        f"{FIRST_LINE} as first_line",
        f"{start if period == DAY else week_start(start)} as period_start",
        f"coalesce(not ({is_refunded(cfg)}), true) as counts",
        "cast(coalesce(size(line_items), 0) as bigint) as n_lines",
        f"{DOCUMENT_ITEMS_VALUE} as items",
        f"{DOCUMENT_DISCOUNTS} as discounts",
        f"{text_money('total_discounts')} as total_discounts",
        f"{DOCUMENT_SHIPPING} as shipping",
    )


def order_sales(pages: DataFrame, cfg: ProfitConfig, *by: str, also: tuple[str, ...] = ()) -> DataFrame:
    """What the newest version of each order adds to its period, apart for each of ``by``; refunded or
    empty orders add 0. ``also`` are further fields of the order."""
    sums = pages.groupBy(*by, "id", "version").agg(
        *[F.expr(f"max({c}) as {c}") for c in ("period_start", "counts", "total_discounts", "shipping", *also)],
        *[F.expr(f"sum({c}) as {c}") for c in ("n_lines", "items", "discounts")],
    )
    counts = "(n_lines > 0 and counts)"
    left_over = "greatest(0, total_discounts - discounts)"
    revenue = f"items - discounts - if(items > 0, {left_over}, 0) + greatest(shipping, 0)"
    sales = latest(sums, [*by, "id"], "version").selectExpr(
        *by,
        "id",
        *also,
        "period_start",
        f"if({counts}, 1L, 0L) as orders",
        f"{cast(f'if({counts}, {revenue}, 0)', AMOUNT)} as revenue",
    )
    return sales.selectExpr("*", f"{without_vat('revenue', cfg.vat_rate)} as revenue_excl_mva")


def _state_schema() -> StructType:
    money = {"items": "decimal(28,4)", "discounts": "decimal(28,4)", "total_discounts": MONEY, "shipping": MONEY}
    schema = StructType().add("id", "long").add("version", "long").add("first_line", "long")
    schema = schema.add("period_start", "date").add("counts", "boolean").add("n_lines", "long")
    for name, kind in money.items():
        schema = schema.add(name, kind)
    return schema


_PAGE = ["id", "version", "first_line"]


def _live_pages(state: DataFrame) -> DataFrame:
    """Of each order the pages of its newest version, of each page what came last."""
    pages = latest(state, _PAGE, "batch")
    best = pages.groupBy("id").agg(F.max("version").alias("version"))
    return pages.join(best, ["id", "version"], "left_semi")


def _both_sides(state: BucketLog, touched: list[int], batch_id: int) -> DataFrame:
    """Pages of a batch's orders: with ``sign`` 1 as they are known now, with -1 as they were before.

    Just ids are compared to find the orders that came before. Their list is stored, so that Spark knows its
    size: a short one is broadcast, and known pages of other orders travel nowhere. All pages of an order
    are dealt by its id, so that they are summed without another exchange.
    """
    fresh, known = state.of_batch(touched, batch_id), state.read(touched, batch_id - 1)
    both = fresh.selectExpr("*", "1 as sign")
    again = known.select("id").join(fresh.select("id"), "id", "left_semi").distinct()
    again.write.mode("overwrite").parquet(f"{state.path}/again")
    again = state.spark.read.schema(again.schema).parquet(f"{state.path}/again")
    if not again.isEmpty():
        old = known.join(again, "id", "left_semi").selectExpr("*", "explode(array(1, -1)) as sign")
        both = old.unionByName(both)
    return latest(both.repartition("id"), ["sign", *_PAGE], "batch")


def sales_writer(spark: SparkSession, table: str, cfg: ProfitConfig, period: str, span: int = SPAN):
    """A ``foreachBatch`` function that books what changed.

    The state keeps the amounts of each page, without lines, in buckets of order ids. A batch logs
    its pages and reads the buckets that they fall into, no other. Its orders are summed from the
    pages known before and from all pages, and the batch's changes take the old amounts off their
    period and add the new ones. So pages of an order may come in any batches. All folders carry
    the batch id and depend on earlier batches only, so a batch that is run again writes the same.
    """
    book = _pages_writer(spark, table, cfg, span)
    return lambda batch, batch_id: book(page_sales(batch, cfg, period), batch_id)


def _pages_writer(spark: SparkSession, table: str, cfg: ProfitConfig, span: int):
    """The same for what ``page_sales`` makes of a batch."""
    state = BucketLog(spark, f"{table}/state", _state_schema())

    def write(pages: DataFrame, batch_id: int) -> None:
        touched = state.append(pages.filter("id is not null"), batch_id, "id", span)
        if not touched:
            return
        both = _both_sides(state, touched, batch_id)
        changes = grouped(order_sales(both, cfg, "sign"), ["period_start"], *_summed("sign * "))
        changes.coalesce(1).write.mode("overwrite").parquet(f"{table}/changes/batch={batch_id}")
        state.merge(touched, batch_id, _live_pages, "id", span)

    return write


def stream_sales(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    cfg: ProfitConfig,
    period: str = DAY,
    files_per_batch: int | None = None,
    span: int = SPAN,
) -> None:
    """Update the running sales table with the files that are new, then stop.

    Every order counts however late it lands, and a later version of an order takes the
    place of the earlier one. Pages without an order id have no version and are left out.
    """
    # Pages are made in the stream itself: a batch is rows by then, and fields unused would be parsed and copied.
    pages = page_sales(stream_orders(spark, source, files_per_batch), cfg, period)
    _run(pages, _pages_writer(spark, table, cfg, span), checkpoint)


def current_sales(spark: SparkSession, table: str) -> DataFrame:
    """The figures of every period: the sum of all booked changes."""
    changes = read_log(spark, f"{table}/changes", _sales_schema())
    return grouped(changes, ["period_start"], *_summed()).filter("orders <> 0")


# --- periods that are final -------------------------------------------------------


def finalize_sales(
    spark: SparkSession, table: str, checkpoint: str, period: str = DAY, delay: str = "2 days", bookings_per_batch: int = 1
) -> None:
    """Publish the periods that are over, then stop.

    The booked changes are a stream of their own: a watermark ``delay`` behind the newest period
    closes the windows before it, and each is published once, with its figures as they stood then.
    Changes that come for a closed window are no part of it; they stay booked, and are the
    period's corrections, also where nothing had come in time. Runs after ``stream_sales``, of which
    it takes in what is new.
    """
    days = "datediff(period_start, date'1970-01-01')"
    # A file per booking. Windows follow the epoch, whose fifth day was a Monday; no session zone plays a part.
    changes = (
        spark.readStream.schema(_sales_schema())
        .option("maxFilesPerTrigger", bookings_per_batch)
        .parquet(f"{table}/changes")
        .selectExpr("*", f"timestamp_seconds(cast({days} as bigint) * 86400) as at")
        .withWatermark("at", delay)
    )
    window = F.window("at", period, startTime="4 days" if period == WEEK else "0 days").alias("window")
    start = "date_add(date'1970-01-01', cast(unix_seconds(window.start) div 86400 as int)) as period_start"
    closed = changes.groupBy(window).agg(*map(F.expr, _summed())).selectExpr(start, *_SUMS)
    write = batch_writer(f"{table}/final", lambda batch: batch)
    query = (
        closed.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    if progress is not None and "watermark" in progress["eventTime"]:
        # Periods that start no later are closed.
        last = progress["eventTime"]["watermark"][:10]
        closed = spark.range(1).selectExpr(f"date_sub(date'{last}', {7 if period == WEEK else 1}) as closed")
        closed.write.mode("overwrite").parquet(f"{table}/closed/batch={progress['batchId']}")


def final_sales(spark: SparkSession, table: str) -> DataFrame:
    """Every period's figures with all changes; ``is_final`` if the period is closed, then ``final_*``
    as it was published, and ``corrected_*``, what came later."""
    closed = read_log(spark, f"{table}/closed", StructType().add("closed", "date")).agg(F.max("closed"))
    published = read_log(spark, f"{table}/final", _sales_schema())
    booked = read_log(spark, f"{table}/changes", _sales_schema())
    both = booked.selectExpr("period_start", "1 as now", *_SUMS).unionByName(
        published.selectExpr("period_start", "0 as now", *_SUMS)
    )
    sums = []
    for c, kind in _SUMS.items():
        sums.append(f"{cast(f'sum({c} * now)', kind)} as {c}")
        sums.append(f"{cast(f'sum({c} * (1 - now))', kind)} as published_{c}")
    totals = grouped(both, ["period_start"], *sums).withColumn("upto", closed.scalar())
    totals = totals.selectExpr("*", "coalesce(period_start <= upto, false) as is_final")
    parts = []
    for c, kind in _SUMS.items():
        parts.append(f"if(is_final, published_{c}, null) as final_{c}")
        parts.append(f"{cast(f'if(is_final, {c} - published_{c}, null)', kind)} as corrected_{c}")
    return totals.selectExpr("period_start", "is_final", *_SUMS, *parts)


# --- records and customers under change ---------------------------------------------


# Kinds of keys that records are kept by, and each order's key; texts sort as the values do.
_KINDS = {
    "day": "cast(period_start as string)",
    "week": f"cast({week_start('period_start')} as string)",
    "order": "lpad(cast(order_number as string), 20, '0')",
    "customer": "nullif(email, '')",
    "weekday": "cast(weekday(period_start) as string)",
    "hour": "lpad(cast(hour as string), 2, '0')",
}
_FIELDS = {"order_number": "long", "email": "string", "hour": "integer"}


#: Buckets of orders and of customers; the other kinds have few keys.
RECORD_BUCKETS = 8


def order_records(spark: SparkSession, table: str, buckets: int = RECORD_BUCKETS, keep: int = KEEP) -> KeyedTotals:
    """The totals by day, week, order, customer, weekday and hour below ``table``."""
    sizes = [buckets if kind in ("order", "customer") else 1 for kind in _KINDS]
    return KeyedTotals(spark, f"{table}/records", _SUMS, ["revenue_excl_mva", "orders"], sizes, keep=keep)


def _record_pages(docs: DataFrame, cfg: ProfitConfig) -> DataFrame:
    """What each page adds to its order's version, with the fields that records are kept by."""
    return page_sales(docs, cfg, DAY, "order_number", "email", f"{wall_hour('created_at')} as hour")


def records_writer(spark: SparkSession, table: str, cfg: ProfitConfig, totals: KeyedTotals, span: int = SPAN):
    """A ``foreachBatch`` function that keeps records and customer counts by what changed."""
    keep = _record_pages_writer(spark, table, cfg, totals, span)
    return lambda batch, batch_id: keep(_record_pages(batch, cfg), batch_id)


def _record_pages_writer(spark: SparkSession, table: str, cfg: ProfitConfig, totals: KeyedTotals, span: int = SPAN):
    """The same for what ``_record_pages`` makes of a batch."""
    schema = _state_schema()
    for name, kind in _FIELDS.items():
        schema = schema.add(name, kind)
    state = BucketLog(spark, f"{table}/orders", schema)
    keys = ", ".join(f"struct({i} as kind, {key} as key)" for i, key in enumerate(_KINDS.values()))

    def write(pages: DataFrame, batch_id: int) -> None:
        touched = state.append(pages.filter("id is not null"), batch_id, "id", span)
        if not touched:
            return
        sales = order_sales(_both_sides(state, touched, batch_id), cfg, "sign", also=tuple(_FIELDS))
        signed = [f"{cast(f'sign * {c}', kind)} as {c}" for c, kind in _SUMS.items()]
        totals.apply(sales.selectExpr(f"inline(array({keys}))", *signed), batch_id)
        state.merge(touched, batch_id, _live_pages, "id", span)

    return write


def stream_records(
    spark: SparkSession, source: str, table: str, checkpoint: str, cfg: ProfitConfig, files_per_batch: int | None = None
) -> None:
    """Bring records and customer counts up to date with the files that are new, then stop."""
    # Pages are made in the stream itself, as for sales.
    pages = _record_pages(stream_orders(spark, source, files_per_batch), cfg)
    _run(pages, _record_pages_writer(spark, table, cfg, order_records(spark, table)), checkpoint)


def current_records(totals: KeyedTotals) -> DataFrame:
    """(record, key, value): per kind the key with most revenue and the one with most orders."""
    names = F.expr(f"array({', '.join(map(quote, _KINDS))})[kind] as kind")
    parts = [
        totals.largest(rank).select(names, F.lit(rank).alias("rank"), "key", F.col(rank).cast(AMOUNT).alias("value"))
        for rank in totals.ranks
    ]
    return parts[0].unionByName(parts[1]).selectExpr("concat(kind, '_', rank) as record", "key", "value")


def customer_frequency(totals: KeyedTotals) -> DataFrame:
    """How many customers have one, two, and three or more orders: (orders, customers)."""
    kind = list(_KINDS).index("customer")
    sizes = totals.sizes().filter(f"kind = {kind}")
    return grouped(sizes, ["least(size, 3L) as orders"], "sum(n) as customers")
