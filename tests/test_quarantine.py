"""Rejected order documents are kept aside with their reasons, good ones come through whole."""

import json

from shop import CFG, line, order

from profitloom.operators import lines as L
from profitloom.sources.orders import read_orders
from profitloom.sources.quarantine import check_orders


def test_planted_documents_are_rejected_and_good_ones_whole(spark, tmp_path):
    good = [order(n, [line("A", price="12.50"), line("B", price=None)], total_discounts=None) for n in range(5)]
    good.append({**order(7, []), "loyalty_tier": "gold", "tags": ["x"]})
    good.append({**order(8, [line("Ø ✓")]), "updated_at": None})
    bad = {
        "{\"id\": 1, \"order_number\":": ["not an order document"],
        "no json at all": ["not an order document"],
        json.dumps({**order(20, []), "id": "five"}): ["not an order document"],
        json.dumps({**order(21, []), "id": None}): ["no order id"],
        json.dumps({**order(22, []), "created_at": "first of July"}): ["no order day"],
        json.dumps({**order(23, []), "created_at": None, "updated_at": "soon"}): ["no order day", "change time"],
        json.dumps(order(24, [line("A", price="12,50")])): ["amount"],
        json.dumps(order(25, [line("A"), line("B", discount="x")])): ["amount"],
        json.dumps(order(26, [], shipping_lines=[{"price": "free"}])): ["amount"],
    }
    feed = tmp_path / "feed" / "day=1"
    feed.mkdir(parents=True)
    (feed / "a.json").write_text("\n".join([*map(json.dumps, good), "", *bad]))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.json").write_text("\n".join(map(json.dumps, good)))
    checked = check_orders(spark, str(tmp_path / "feed"), str(tmp_path / "checked"))
    rejected = {r["value"]: r["problems"] for r in checked.rejected().collect()}
    assert rejected == bad
    assert all(r["file"].endswith("day=1/a.json") for r in checked.rejected().collect())
    text = lambda frame: sorted(str(r) for r in frame.collect())
    assert text(checked.orders()) == text(read_orders(spark, str(tmp_path / "plain")))
    assert L.line_items(checked.orders(), CFG).count() == 11
    counts = {(r["kind"], r["name"]): r["documents"] for r in checked.counts().collect()}
    assert counts[("good", "")] == len(good) and counts[("rejected", "")] == len(bad)
    assert counts[("problem", "amount")] == 3 and counts[("unknown field", "loyalty_tier")] == 1


def test_an_empty_feed(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text("")
    checked = check_orders(spark, str(tmp_path / "feed"), str(tmp_path / "checked"))
    assert checked.counts().count() == checked.orders().count() == checked.rejected().count() == 0
