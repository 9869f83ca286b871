"""Ranked search against scoring every document for every item in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from profitloom.llm import lexical as X

DOCS = "doc_id long, text string, rank string, `_item` int"
ITEMS = "item_id string, text string, score int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for key, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort(key=lambda s: s[:3])
        out += [(key, r, i, -s) for r, (s, _, _, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def corpus(seed=0, n=250):
    rng = random.Random(seed)
    words = ["a", "The", "THE", "été", "x9", "\U0001f600", "\u212a", "zz", "b-c", "d_e", "q\x00r", "ſ"] + [f"w{i}" for i in range(60)]
    docs = [(1, None), (2, ""), (3, " ,;"), (None, "the a w1"), (None, "the a w1"), (5, "w1 " * 5000)]
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 40])))
        docs += [(rng.choice([None, 1000 + i, 1000 + i % 7]), text)] * rng.choice([1, 1, 1, 30])
    items = [("i1", None), ("i2", ""), ("i3", "nothing here"), (None, "the w1"), ("i4", "The the THE a"), ("i4", "the a")]
    items += [(f"r{k}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for k in range(25)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(7),
        spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS),
    )


def run(spark, docs, items, top=20):
    got = X.search(*frames(spark, docs, items), top=top)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("top", [20, 3])
def test_equals_a_plain_search(spark, top):
    docs, items = corpus()
    got = run(spark, docs, items, top)
    assert got == plain_search(docs, items, top)
    # Copies of one text share a score, so ids decide.
    assert len({(i, s) for i, _, _, s in got}) < len(got)


def test_slices_of_items_small_parts_and_joined_classes(spark, monkeypatch):
    docs, items = corpus(4, 120)
    for name, value in (("ITEM_BYTES", 300), ("_CELLS", 64), ("_PARTS", 50), ("BROADCAST_BYTES", 0), ("_BAG_BYTES", 500), ("_TEXT_BYTES", 900), ("_EXACT", 0)):
        monkeypatch.setattr(X, name, value)
    assert run(spark, docs, items) == plain_search(docs, items)


def test_terms_with_one_hash_are_told_apart(spark, monkeypatch):
    docs, items = corpus(5, 60)
    monkeypatch.setattr(X.ragged, "hash_spans", lambda data, start, end, base=0: (end - start).astype(np.uint64) % np.uint64(2))
    words = sorted({t.encode() for _, x in items for t in terms(x)})
    vocabulary = X.Vocabulary.of(words)
    for _, text in docs:
        raw = "".join(t for t in terms(text)).encode()
        ends = np.cumsum([len(t.encode()) for t in terms(text)], dtype=np.int64)
        starts = ends - np.array([len(t.encode()) for t in terms(text)], np.int64)
        got = vocabulary.find(np.frombuffer(raw, np.uint8), starts, ends)
        want = [words.index(t.encode()) if t.encode() in words else -1 for t in terms(text)]
        assert got.tolist() == want


def test_classes_are_bags_with_their_length(spark):
    docs, items = corpus(6, 80)
    words = sorted({t.encode() for _, x in items for t in terms(x)})
    frame = frames(spark, docs, items)[0]
    X.ship(spark)
    held = X._restricted(frame, X.Vocabulary.of(words), "text", "doc_id")
    counted = [Counter(terms(t)) for _, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for c in counted)
    want = {
        (tuple(sorted((t, n) for t, n in c.items() if t.encode() in words)), 75 + (25 * sum(c.values()) * n_docs) // n_terms)
        for c in counted if any(t.encode() in words for t in c)
    }
    assert X.classes_of(held, n_docs, n_terms)[1].count() == len(want) < len(counted)


def test_empty_tables(spark):
    docs, items = corpus(7, 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []
    assert run(spark, docs, [("x", "!")]) == []
