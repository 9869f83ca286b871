"""Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from profitloom.llm import merkle as M
from profitloom.llm.catalog import op12_merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, `_g` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def grow(digests):
    """Levels from the leaves up to one node."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 8]) for i in range(0, len(low), 8)])
    return levels


def segments(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
        i //= 8
    return out


def plain_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: grow([leaf(r) for r in groups[g]]) for g in order}
    top = grow([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            path = segments(trees[g], i) + segments(top, j)
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                now = (*row[:4], row[4] and row[4].translate(LOWER))
            d = leaf(now)
            for left, right in path:
                d = h(left, d, right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, h(*(a + b for a, b in path)), d, d == root))
    return out


def corpus(sizes, seed=0):
    rng = random.Random(seed)
    words = ["The", "CAT", "é", "\U0001f600", "ß", "x"]
    out = []
    for lang, n in sizes:
        for _ in range(n):
            text = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(5))])
            out.append((rng.choice([None, rng.randrange(60), rng.randrange(10**6)]), rng.choice([None, "", "web"]), lang, rng.choice([None, 7]), text))
    return out + out[:5]


def audit(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    return sorted((tuple(r) for r in M.audit(docs).collect()), key=str)


@pytest.mark.parametrize(
    "sizes",
    [
        [("en", 1)],
        [("en", 8), ("de", 9), (None, 65), ("", 1), ("é", 2)],
        [(f"l{i}", 1 + i % 3) for i in range(70)],
        [("en", 600)],
    ],
)
def test_audit_equals_a_plain_tree(spark, sizes):
    rows = corpus(sizes)
    got = audit(spark, rows)
    assert got == sorted(plain_audit(rows), key=str)
    assert [c for c, _ in M.audit(spark.createDataFrame([], DOCS)).dtypes] == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    ]


def test_many_equal_rows(spark):
    rows = [(None, "web", "en", 3, "Aa")] * 300 + [(5, "web", "en", 3, "Aa")] * 300 + corpus([("en", 20)])
    assert audit(spark, rows) == sorted(plain_audit(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert M.audit(docs).count() == 0
    rows = M.leaves_with_claims(docs, ("doc_id", "text"), "text", F.lit(False))
    assert M.build(rows, "_group", "_key", "_leaf").root is None


def test_some_leaves_asked_for(spark):
    rows = corpus([("en", 200), ("de", 70)], 3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    manifest = M.build(M.leaves_with_claims(docs, ("doc_id", "text"), "text", F.lit(False)), "_group", "_key", "_leaf")
    every = {(r["_g"], r["_i"]): (r["_d"], r["_proof"]) for r in M.proofs(manifest).collect()}
    wanted = manifest.leaves.where("_g = '=en' and _i in (0, 7, 8, 199) or _g = '=de' and _i = 69")
    some = {(r["_g"], r["_i"]): (r["_d"], r["_proof"]) for r in M.proofs(manifest, wanted).collect()}
    assert len(some) == 5 and all(every[k] == v for k, v in some.items())
    assert len(every) == len(rows)


def test_query_equals_a_plain_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted(plain_audit(rows), key=str)
    assert {r[-1] for r in got} == {True, False}
