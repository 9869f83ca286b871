"""Decontamination against all windows, and the Hamming index against all pairs."""

import random

from pyspark.sql import functions as F

import plain
from profitloom.llm import decontam

DOCS = "doc_id long, text string, item_id int, `_at` string"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda n=4: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [" ".join(word() for _ in range(rng.randrange(12, 60))) for _ in range(12)]
    items += ["tiny", "two words", "la la la la la la la la la la la la", None, "", "... !", items[0]]
    texts = [None, "", "tiny", "A TINY thing", "here two words stand", "la " * 40, items[1].split(" ", 2)[2]]
    for _ in range(60):
        noise = [word() for _ in range(rng.randrange(80))]
        passage = (rng.choice(items[:12])).split()
        for _ in range(rng.randrange(4)):
            kind, at = rng.randrange(3), rng.randrange(len(passage))
            if kind == 0:
                passage[at] = word()
            elif kind == 1:
                passage.insert(at, word())
            else:
                del passage[at]
        at = rng.randrange(len(noise) + 1)
        joined = noise[:at] + passage + noise[at:]
        texts.append(" ".join(w.upper() + "!!" if rng.random() < 0.2 else w for w in joined))
    texts.append(" ".join(word() for _ in range(4000)) + " " + items[3])
    return items, texts + texts[10:14]


def test_matches_equal_all_windows(spark):
    items, texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame([(100 + i, t, "y") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(docs, benchmark).collect()}
    want = {(i, 100 + j): s for i, t in enumerate(texts) for j, x in enumerate(items) if (s := plain.leaks(t, x))}
    assert set(got) == set(want) and len(want) > 25
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_null_ids_and_copies_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "other " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(5, text)], "item_id long, text string")
    got = decontam.matches(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["similarity"]) for r in got) == [(0, 5, 1.0), (1, 5, 1.0)]
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [2]
    assert decontam.matches(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == 4


def test_blocks_meet_every_fingerprint_within_the_radius(spark):
    rng = random.Random(3)
    rule = decontam.Contamination()
    rows = []
    for k in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), k % 21):
            b ^= 1 << bit
        rows.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    pairs = spark.createDataFrame(rows, "a long, b long")
    near = decontam.block_neighbours("a", rule.blocks, rule.radius)
    met = F.arrays_overlap(near, decontam.block_values("b", rule.blocks))
    assert pairs.where(~met).count() == 0
    assert max(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in rows) == rule.radius


def test_simhash_is_the_majority_of_each_bit(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(9)]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    got = df.agg(F.count(F.lit(1)).alias("n"), *decontam.lane_sums(F.col("h"))).select(decontam.fingerprint("n")).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 9)
    assert got & (1 << 64) - 1 == want
