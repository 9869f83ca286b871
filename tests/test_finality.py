"""Bucketed state and periods that become final."""

import json
import os
import random

import pytest
from shop import CFG, by, line, order

from profitloom.storage import new_folder
from profitloom.streaming import orders as S
from profitloom.streaming.buckets import FAN, BucketLog


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def land(name, *docs):
        path = folder / f"{name}.json"
        path.write_text("\n".join(json.dumps(d) for d in docs))
        # Files are taken in the order in which they landed.
        os.utime(path, (land.clock, land.clock))
        land.clock += 1

    land.clock = 1_700_000_000
    land.path, land.table, land.progress = str(folder), str(tmp_path / "table"), str(tmp_path / "progress")
    return land


def on(day, number, version=0, month=7, **fields):
    created = f"2024-{month:02d}-{day:02d}T12:00:00+02:00"
    changed = f"2024-{month + version:02d}-{day:02d}T13:00:00+02:00"
    return order(number, [line("A")], created=created, updated_at=changed, **fields)


def sales(frame):
    return {str(r["period_start"]): (r["orders"], float(r["revenue"])) for r in frame.collect() if r["orders"]}


def plain(docs):
    newest = {}
    for d in docs:
        if d["id"] not in newest or d["updated_at"] > newest[d["id"]]["updated_at"]:
            newest[d["id"]] = d
    out = {}
    for d in newest.values():
        if d["financial_status"] != "refunded":
            n, revenue = out.get(d["created_at"][:10], (0, 0.0))
            out[d["created_at"][:10]] = (n + 1, revenue + 100.0)
    return out


def test_bytes_read_by_a_batch_stay_flat(spark, feed):
    read, docs = [], []
    state = BucketLog(spark, f"{feed.table}/state", S._state_schema())
    write = S.sales_writer(spark, feed.table, CFG, S.DAY, span=16)
    size = lambda paths: sum(
        os.path.getsize(os.path.join(p, f)) for p in paths for f in os.listdir(p) if f.startswith("part")
    )
    for n in range(32):
        # Running numbers, and changes to orders of the last few batches.
        new = [on(1 + n % 28, 16 * n + k) for k in range(16)]
        late = [{**d, "updated_at": "2024-12-01T00:00:00+01:00", "financial_status": "refunded"} for d in docs[-20::7]]
        docs += new + late
        batch = spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in new + late], 1))
        write(batch, n)
        state = BucketLog(spark, f"{feed.table}/state", S._state_schema())
        touched = [b for b, batches in state.logged.items() if n in batches]
        read.append(size([p for b in touched for p in state.pieces(b, n)]))
    assert max(read[16:]) < 1.5 * max(read[4:16])
    assert sales(S.current_sales(spark, feed.table)) == plain(docs)


def test_pieces_are_merged_and_old_ones_can_go(spark, feed):
    docs = []
    write = S.sales_writer(spark, feed.table, CFG, S.DAY, span=10**6)
    rows = lambda ds: spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in ds], 1))
    for n in range(2 * FAN + 3):
        new = [on(1 + n % 28, n), {**on(1, 0), "updated_at": f"2024-08-01T00:{n:02d}:00+02:00"}]
        docs += new
        write(rows(new), n)
    state = BucketLog(spark, f"{feed.table}/state", S._state_schema())
    assert all(len(state.pieces(b, n)) < FAN for b in state.logged)
    before = state.read(sorted(state.logged), n).count()
    state.vacuum(n)
    again = BucketLog(spark, f"{feed.table}/state", S._state_schema())
    assert sum(map(len, again.logged.values())) < FAN and again.read(sorted(state.logged), n).count() == before
    # A batch that runs again after its pieces were merged books the same.
    booked = sales(S.current_sales(spark, feed.table))
    for _ in range(2):
        write(rows([on(20, 99)]), n + 1)
    assert sales(S.current_sales(spark, feed.table)) == plain([*docs, on(20, 99)]) != booked


def test_a_batch_run_again_after_its_merge_books_the_same(spark, feed):
    write = S.sales_writer(spark, feed.table, CFG, S.DAY, span=10**6)
    rows = lambda *ds: spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in ds], 1))
    for n in range(FAN - 1):
        write(rows(on(1, 1, version=0 if n == 0 else 1)), n)
    for again in (write, write, S.sales_writer(spark, feed.table, CFG, S.DAY, span=10**6)):
        # The eighth piece merges the bucket and takes the order's earlier version off.
        again(rows(on(1, 1, version=2, financial_status="refunded")), FAN - 1)
        assert sales(S.current_sales(spark, feed.table)) == {}


def test_known_pages_of_other_orders_stay_and_a_batch_is_dealt_once(spark, feed):
    state = BucketLog(spark, f"{feed.table}/state", S._state_schema())
    rows = lambda *ds: spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in ds], 1))
    log = lambda batch, n: state.append(S.page_sales(batch, CFG, S.DAY), n, "id")
    log(rows(*[on(1, k) for k in range(40)]), 0)
    exchanges = lambda both: S.order_sales(both, CFG, "sign")._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    # None of the orders came before: their pages alone are read, and dealt once, by id.
    both = S._both_sides(state, log(rows(*[on(2, k) for k in range(90, 99)]), 1), 1)
    assert exchanges(both) == 1 and both._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    assert "batch=0" not in " ".join(both.inputFiles())
    assert [(r["sign"], r["count"]) for r in both.groupBy("sign").count().collect()] == [(1, 9)]
    # One came before, and is summed from both versions; the others are not.
    both = S._both_sides(state, log(rows(on(2, 3, version=1, financial_status="refunded"), on(2, 70)), 2), 2)
    got = S.order_sales(both, CFG, "sign").collect()
    assert sorted((r["sign"], r["id"], r["orders"]) for r in got) == [(-1, 5003, 1), (1, 5003, 0), (1, 5070, 1)]


def test_only_fields_in_use_are_parsed_from_the_feed(spark, feed, monkeypatch):
    plans, run = [], S._run
    monkeypatch.setattr(S, "_run", lambda frame, *rest: plans.append(frame.columns) or run(frame, *rest))
    feed("a", on(1, 1), on(2, 2))
    S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG)
    assert "email" not in plans[0] and "line_items" not in plans[0] and "n_lines" in plans[0]
    assert sales(S.current_sales(spark, feed.table)) == {"2024-07-01": (1, 100.0), "2024-07-02": (1, 100.0)}


@pytest.mark.parametrize("seed", [0, 1])
def test_final_figures_and_corrections_add_up_in_any_order(spark, feed, seed):
    docs = [on(d, 100 * d + k) for d in range(1, 25) for k in range(2)]
    docs += [on(d, 100 * d, version=1, financial_status="refunded") for d in (2, 9)]
    docs += [on(3, 999), on(24, 998)]
    files = [docs[i : i + 6] for i in range(0, len(docs), 6)]
    if seed:
        random.Random(seed).shuffle(files)
    for i, file in enumerate(files):
        feed(f"f{i}", *file)
    S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG, files_per_batch=1)
    for _ in range(2):
        S.finalize_sales(spark, feed.table, feed.progress + "-final")
    got = by(S.final_sales(spark, feed.table), "period_start")
    want = plain(docs)
    assert {str(d): (r["orders"], float(r["revenue"])) for d, r in got.items() if r["orders"]} == want
    for day, r in got.items():
        # The newest day is the 24th and the delay two days, so windows up to the 22nd are closed.
        assert r["is_final"] == (str(day) <= "2024-07-21")
        if r["is_final"]:
            assert r["final_orders"] + r["corrected_orders"] == r["orders"]
            assert r["final_revenue"] + r["corrected_revenue"] == r["revenue"]
    if seed == 0:
        late = {str(d): r["corrected_orders"] for d, r in got.items() if r["corrected_orders"]}
        assert late == {"2024-07-02": -1, "2024-07-03": 1, "2024-07-09": -1}
    # What comes later still is a correction, and published figures stay.
    feed("z", on(5, 997), on(24, 996))
    S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG, files_per_batch=1)
    S.finalize_sales(spark, feed.table, feed.progress + "-final")
    later = by(S.final_sales(spark, feed.table), "period_start")
    day = next(d for d in later if str(d) == "2024-07-05")
    assert later[day]["orders"] == got[day]["orders"] + 1
    assert later[day]["final_orders"] == got[day]["final_orders"]
    assert later[day]["corrected_orders"] == got[day]["corrected_orders"] + 1


def test_weeks_close_on_mondays(spark, feed):
    for i, days in enumerate(([1, 7], [8, 14], [15], [22, 23])):
        feed(f"f{i}", *[on(d, d) for d in days])
    S.stream_sales(spark, feed.path, feed.table, feed.progress, CFG, S.WEEK, files_per_batch=1)
    S.finalize_sales(spark, feed.table, feed.progress + "-final", S.WEEK)
    got = {str(r["period_start"]): (r["orders"], r["is_final"]) for r in S.final_sales(spark, feed.table).collect()}
    assert got == {"2024-07-01": (2, True), "2024-07-08": (2, True), "2024-07-15": (1, False), "2024-07-22": (2, False)}
