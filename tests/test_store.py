"""The bucketed order table against reading all documents at once."""

import json
import os
import random

import pytest
from shop import CFG, line, order

from profitloom.operators import lines as L
from profitloom.sources.orders import newest_orders, read_orders
from profitloom.streaming import orders as S
from profitloom.streaming import store as T
from profitloom.streaming.store import STORED, OrderStore


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def land(name, *docs):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(d) for d in docs))
        os.utime(folder / f"{name}.json", (land.clock, land.clock))
        land.clock += 1

    land.clock = 1_700_000_000
    land.path, land.store, land.progress = str(folder), str(tmp_path / "store"), str(tmp_path / "progress")
    return land


def version(number, at, lines=1, **fields):
    doc = order(number, [line(f"P{k}") for k in range(lines)], **fields)
    return {**doc, "updated_at": f"2024-07-{at:02d}T10:00:00+02:00"}


def rows(frame):
    return sorted((json.dumps(r.asDict(True), default=str, sort_keys=True) for r in frame.select(*sorted(STORED.names)).collect()))


def in_batch(spark, feed):
    return L.with_order_sums(newest_orders(read_orders(spark, feed.path)))


def files(feed):
    root = os.path.join(feed.store, "current")
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, fs in os.walk(root) for f in fs if f.startswith("part")
    }


def test_a_refresh_rewrites_only_the_buckets_of_the_new_file(spark, feed):
    feed("a", *[version(n, 1, 1 + n % 3) for n in range(100)])
    store = OrderStore(spark, feed.store, span=10)
    take = lambda: S.store_orders(spark, feed.path, store, feed.progress, 1, refresh_every=1)
    take()
    before = files(feed)
    # Ids are 5000 and up: order 7 is in bucket 500, order 63 and the new 109 in 506 and 510.
    feed("b", version(7, 2, financial_status="refunded"), version(63, 2), version(109, 2))
    take()
    after = files(feed)
    changed = {path.split("bucket=")[1].split("/")[0] for path, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"500", "506", "510"}
    assert rows(store.read()) == rows(in_batch(spark, feed))
    assert store.refresh().buckets == []


@pytest.mark.parametrize("every", [1, 3, 100])
def test_any_refresh_rhythm_equals_reading_all_documents(spark, feed, every):
    rng = random.Random(2)
    docs = [version(rng.randrange(30), day, rng.randrange(3), total_discounts=str(rng.randrange(9))) for day in range(1, 25)]
    # Pages of one version in different files, the newest version's page first; an older page late.
    page = lambda at, first, n: {**version(77, at, n), "first_line": first}
    docs += [page(2, 0, 2), page(1, 0, 5), page(2, 2, 3), page(1, 5, 1)]
    docs += [{**version(50 + k, 1), "id": None} for k in range(3)]
    seen = {}
    for d in docs:
        seen[(d["id"], d["updated_at"], d.get("first_line"), d["order_number"])] = d
    docs = list(seen.values())
    rng.shuffle(docs)
    for i in range(0, len(docs), 6):
        feed(f"f{i:02d}", *docs[i : i + 6])
    store = OrderStore(spark, feed.store, span=7)
    S.store_orders(spark, feed.path, store, feed.progress, 1, refresh_every=every)
    want = rows(in_batch(spark, feed))
    assert rows(OrderStore(spark, feed.store, span=7).read()) == want
    store.refresh()
    store.vacuum()
    again = OrderStore(spark, feed.store, span=7)
    assert rows(again.read()) == want and not any(again.log.logged.values())
    assert L.line_items(store.read(), CFG).count() == L.line_items(in_batch(spark, feed), CFG).count()


def test_a_refresh_that_breaks_off_is_taken_up(spark, feed, monkeypatch):
    store = OrderStore(spark, feed.store, span=10)
    feed("a", *[version(n, 1) for n in range(30)])
    S.store_orders(spark, feed.path, store, feed.progress, 1, refresh_every=1)
    feed("b", version(3, 2, 2), version(12, 2, 3))

    def broken(self, upto):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(T.OrderStore, "_put_in_place", broken)
        with pytest.raises(Exception, match="lost"):
            S.store_orders(spark, feed.path, store, feed.progress, 1, refresh_every=1)
    later = OrderStore(spark, feed.store, span=10)
    assert later.merged_upto() == 0
    assert rows(later.read()) == rows(in_batch(spark, feed))
    assert later.merged_upto() == 1
    # The stream runs the batch again, which changes nothing.
    S.store_orders(spark, feed.path, later, feed.progress, 1, refresh_every=1)
    assert rows(later.read()) == rows(in_batch(spark, feed))


def test_documents_are_parsed_twice_at_most(spark):
    from profitloom.catalog import all_queries

    for name in ("line_items_nested", "order_fields", "orders_source"):
        frame = all_queries()[name](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("FileScan json") <= 2, name


def test_current_pages_equal_the_two_steps(spark, feed):
    docs = [version(n, day, n % 4) for n in range(12) for day in (1, 3, 2)]
    docs += [{**version(7, 9, 2), "first_line": 0}, {**version(7, 9, 5), "first_line": 2}]
    docs += [{**version(90 + k, 1, k), "id": None} for k in range(3)]
    feed("a", *docs)
    assert rows(L.current_pages(read_orders(spark, feed.path))) == rows(in_batch(spark, feed))


def test_an_empty_store(spark, feed):
    assert OrderStore(spark, feed.store).read().count() == 0
    assert OrderStore(spark, feed.store).refresh().upto == -1
