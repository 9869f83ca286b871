"""Records and customer counts under change against counting all orders anew."""

import json
from collections import Counter, defaultdict

import pytest
from shop import CFG, line, order

from profitloom.streaming import orders as S


def doc(number, day, price, email="a@x", at=1, status="paid", hour=12):
    created = f"2024-07-{day:02d}T{hour:02d}:30:00+02:00"
    return order(number, [line("A", price=str(price))], created=created, email=email, financial_status=status,
                 updated_at=f"2024-08-01T00:{at:02d}:00+02:00")


def plain(docs):
    newest = {}
    for d in docs:
        if d["id"] not in newest or d["updated_at"] >= newest[d["id"]]["updated_at"]:
            newest[d["id"]] = d
    live = [d for d in newest.values() if d["financial_status"] != "refunded"]
    revenue, orders, customers = defaultdict(float), Counter(), Counter()
    for d in live:
        amount = float(d["line_items"][0]["price"]) * 0.8
        keys = [("day", d["created_at"][:10]), ("order", f"{d['order_number']:020d}"), ("hour", d["created_at"][11:13])]
        if d["email"]:
            keys.append(("customer", d["email"]))
            customers[d["email"]] += 1
        for key in keys:
            revenue[key] += amount
            orders[key] += 1
    out = {}
    for kind in ("day", "order", "customer", "hour"):
        for name, held in (("revenue_excl_mva", revenue), ("orders", orders)):
            best = min(((-v, k[1]) for k, v in held.items() if k[0] == kind), default=None)
            if best:
                out[f"{kind}_{name}"] = (best[1], round(-best[0], 4))
    return out, dict(Counter(min(n, 3) for n in customers.values()))


@pytest.mark.parametrize(("buckets", "keep"), [(2, 1)])
def test_records_equal_a_fresh_count_after_every_batch(spark, tmp_path, buckets, keep):
    totals = S.order_records(spark, str(tmp_path), buckets, keep)
    write = S.records_writer(spark, str(tmp_path), CFG, totals, span=8)
    batches = [
        [doc(n, 1 + n % 5, 100 + n, f"c{n % 4}@x", hour=8 + n % 3) for n in range(12)],
        # The largest order, day and customer go; then the next ones, more than any list keeps.
        [doc(11, 2, 111, "c3@x", 2, "refunded"), doc(10, 1, 110, "c2@x", 2, "refunded"), doc(9, 5, 109, "c1@x", 2, "refunded")],
        [doc(n, 1 + n % 5, 100 + n, f"c{n % 4}@x", 3, "refunded") for n in (8, 7, 6, 5)],
        # An order moves to another customer and day, one comes back, an older version comes late, one has no customer.
        [doc(4, 3, 500, "c9@x", 4), doc(11, 2, 111, "c3@x", 5), doc(4, 5, 104, "c0@x", 1), doc(20, 3, 70, None), doc(21, 3, 70, "")],
        [doc(n, 1 + n % 5, 100 + n, f"c{n % 4}@x", 9, "refunded") for n in range(12)],
        [doc(20, 3, 70, None, 9, "refunded"), doc(21, 3, 70, "", 9, "refunded")],
        [doc(1, 6, 5, "c1@x", 10)],
    ]
    seen = []
    for n, docs in enumerate(batches):
        seen += docs
        rows = spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs], 1))
        write(rows, n)
        if n == 2:
            write(rows, n)  # run again
        kinds = ("day", "order", "customer", "hour")
        got = {r["record"]: (r["key"], round(float(r["value"]), 4)) for r in S.current_records(totals).collect()
               if r["record"].split("_")[0] in kinds}
        records, customers = plain(seen)
        assert got == records
        assert {r["orders"]: r["customers"] for r in S.customer_frequency(totals).collect()} == customers
    # Another process takes the same lists from the folders.
    again = S.order_records(spark, str(tmp_path), buckets, keep)
    assert {r["record"] for r in S.current_records(again).collect()} >= set(records)


def test_a_batch_looks_old_totals_up_once(spark, tmp_path, monkeypatch):
    """Lists are filled again from all totals only where retractions used them up."""
    totals = S.order_records(spark, str(tmp_path), 2, 2)
    write, read, reads = S.records_writer(spark, str(tmp_path), CFG, totals, span=8), totals.log.read, []
    monkeypatch.setattr(totals.log, "read", lambda buckets, upto: reads.append(list(buckets)) or read(buckets, upto))
    batches = [
        [doc(n, 1 + n % 3, 100 + n, f"c{n % 4}@x") for n in range(12)],
        [doc(n, 1 + n % 3, 100 + n, f"c{n % 4}@x") for n in range(12, 16)],
        [doc(n, 1 + n % 3, 100 + n, f"c{n % 4}@x", 2, "refunded") for n in range(16)],
    ]
    counts = []
    for n, docs in enumerate(batches):
        write(spark.read.schema(S.ORDER).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs], 1)), n)
        counts.append(len(reads))
    assert counts[:2] == [1, 2] and counts[2] > 3
    assert S.current_records(totals).count() == 0
