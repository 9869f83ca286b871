"""Incremental orders and streamed sales."""

import json

import pytest
from shop import CFG, by, line, order

from profitloom.operators import lines as L
from profitloom.streaming import orders as S


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def land(name, *docs):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(d) for d in docs))

    land.path = str(folder)
    land.table = str(tmp_path / "table")
    land.progress = str(tmp_path / "progress")
    return land


def at(doc, day, **changes):
    return {**doc, "updated_at": f"2024-07-{day:02d}T10:00:00+02:00", **changes}


def test_newest_version_wins_across_and_within_batches(spark, feed):
    first, second = order(1, [line("A")]), order(2, [line("B")])
    feed("a", at(first, 3, financial_status="refunded"), at(first, 1), at(second, 1))
    feed("b", at(first, 2, financial_status="pending"), at(second, 2, fulfillment_status=None))
    S.ingest_orders(spark, feed.path, feed.table, feed.progress, files_per_batch=1)
    got = by(S.current_orders(spark, feed.table), "order_number")
    assert len(got) == 2
    assert got[1]["financial_status"] == "refunded"
    assert got[2]["fulfillment_status"] is None


def test_later_runs_take_only_new_files_and_compaction_changes_nothing(spark, feed):
    feed("a", at(order(1, [line("A")]), 1))
    S.ingest_orders(spark, feed.path, feed.table, feed.progress)
    feed("b", at(order(2, [line("A"), line("B")]), 1))
    S.ingest_orders(spark, feed.path, feed.table, feed.progress)
    S.ingest_orders(spark, feed.path, feed.table, feed.progress)
    current = S.current_orders(spark, feed.table)
    assert L.line_items(current, CFG).count() == 3
    base = S.compact_orders(spark, feed.table)
    compacted = S.current_orders(spark, feed.table, base)
    assert compacted.exceptAll(current).count() == current.exceptAll(compacted).count() == 0
    feed("c", at(order(1, [line("A")]), 5, financial_status="refunded"))
    S.ingest_orders(spark, feed.path, feed.table, feed.progress)
    later = S.current_orders(spark, feed.table, base)
    assert by(later, "order_number")[1]["financial_status"] == "refunded" and later.count() == 2
    again = S.compact_orders(spark, feed.table, base)
    assert spark.read.parquet(again.path).exceptAll(later).count() == 0 and again.upto > base.upto
    # Compacted batches are not read again.
    files = S._versions(spark, feed.table, again).inputFiles()
    read = S._versions(spark, feed.table, again)._jdf.queryExecution().executedPlan().toString()
    assert files and f"batch#" in read and f"> {again.upto}" in read


def test_newest_version_is_told_by_the_instant(spark, feed):
    # The clock goes back between the two: the later change carries the smaller text.
    paid = {**order(1, [line("A")]), "updated_at": "2024-10-27T02:30:00+02:00"}
    refunded = {**paid, "updated_at": "2024-10-27T02:10:00+01:00", "financial_status": "refunded"}
    feed("a", refunded)
    feed("b", paid)
    S.ingest_orders(spark, feed.path, feed.table, feed.progress, files_per_batch=1)
    assert S.current_orders(spark, feed.table).first()["financial_status"] == "refunded"
    from profitloom.sources.orders import newest_orders, read_orders

    assert newest_orders(read_orders(spark, feed.path)).first()["financial_status"] == "refunded"
    S.stream_sales(spark, feed.path, feed.table, feed.progress + "-s", CFG, files_per_batch=1)
    assert S.current_sales(spark, feed.table).count() == 0


def test_a_repeated_batch_changes_nothing(spark, feed):
    from profitloom.sources.orders import read_orders
    from profitloom.streaming.log import batch_writer

    feed("a", at(order(1, [line("A")]), 1), at(order(2, [line("A")]), 1))
    write = batch_writer(feed.table, lambda batch: batch)
    for _ in range(2):
        write(read_orders(spark, feed.path), 0)
    assert S.current_orders(spark, feed.table).count() == 2


@pytest.mark.parametrize(
    ("period", "starts"),
    [(S.DAY, ["2024-07-01", "2024-07-07", "2024-07-08"]), (S.WEEK, ["2024-07-01", "2024-07-08"])],
)
def test_sales_follow_shop_days_and_monday_weeks(spark, feed, period, starts):
    # Late evening and just past midnight, shop time.
    feed("a", order(1, [line("A")], created="2024-07-01T00:10:00+02:00"))
    feed(
        "b",
        order(2, [line("A")], created="2024-07-07T23:50:00+02:00", total_discounts="20"),
        order(3, [line("A")], created="2024-07-08T00:05:00+02:00"),
        order(4, [line("A")], created="2024-07-08T00:05:00+02:00", financial_status="refunded"),
        order(5, [], created="2024-07-08T00:05:00+02:00"),
    )
    S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG, period)
    got = by(S.current_sales(spark, feed.table), "period_start")
    assert sorted(str(day) for day in got) == starts
    assert sum(r["orders"] for r in got.values()) == 3
    assert float(sum(r["revenue"] for r in got.values())) == 280


def test_late_orders_count_and_later_versions_replace_earlier_ones(spark, feed):
    run = lambda: S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG, files_per_batch=1)
    sales = lambda: {str(r["period_start"]): (r["orders"], float(r["revenue"]))
                     for r in S.current_sales(spark, feed.table).collect()}
    first = order(1, [line("A")], created="2024-07-10T12:00:00+02:00")
    feed("a", at(first, 10))
    run()
    feed("b", at(order(2, [line("A")], created="2024-07-09T12:00:00+02:00"), 10))
    feed("c", at(order(3, [line("A")], created="2024-07-10T13:00:00+02:00"), 10))
    feed("d", at(order(4, [line("A")], created="2024-01-01T12:00:00+01:00"), 10))
    run()
    assert sales() == {"2024-01-01": (1, 100), "2024-07-09": (1, 100), "2024-07-10": (2, 200)}
    feed("e", at(first, 12, financial_status="refunded"))
    feed("f", at(first, 11, total_discounts="20"))
    run()
    assert sales() == {"2024-01-01": (1, 100), "2024-07-09": (1, 100), "2024-07-10": (1, 100)}
    feed("g", at(first, 13, total_discounts="20"), at(order(4, [], created="2024-01-01T12:00:00+01:00"), 13))
    run()
    assert sales() == {"2024-07-09": (1, 100), "2024-07-10": (2, 180)}


def test_a_repeated_sales_batch_changes_nothing(spark, feed):
    from profitloom.sources.orders import read_orders

    feed("a", at(order(1, [line("A")]), 1), at(order(2, [line("A")]), 1))
    write = S.sales_writer(spark, feed.table, CFG, S.DAY)
    docs = read_orders(spark, feed.path)
    for batch in (0, 0, 1, 1):
        write(docs, batch)
    row = S.current_sales(spark, feed.table).collect()
    assert [(r["orders"], float(r["revenue"])) for r in row] == [(2, 200)]
