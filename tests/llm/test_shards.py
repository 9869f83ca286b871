"""The uniform shuffle: exact sizes, whole rows, fair draws."""

import zlib

import numpy as np
import pytest

from profitloom.llm import shards
from profitloom.llm.catalog import op8_sharding

SF_DIR = "/root/testdata/sf0.001"
ROWS = "doc_id long, size long, text_crc32 long"


@pytest.mark.parametrize(("n", "part_rows", "cell_rows"), [(0, 10, 10), (1, 10, 10), (23, 10, 10), (1000, 100, 7), (1000, 10_000, 10_000)])
def test_sizes_are_exact_and_rows_whole(spark, n, part_rows, cell_rows):
    rows = [(i if i % 11 else None, i % 3, i % 5) for i in range(n)] + [(1, 1, 1)] * (5 if n > 100 else 0)
    df = spark.createDataFrame(rows, ROWS)
    got = shards.shuffle_into_shards(df, ["doc_id", "size", "text_crc32"], 24, 1, part_rows, cell_rows, 3).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_copies_of_one_row_spread_over_parts_and_shards(spark, monkeypatch):
    rows = [(7, 1, 1)] * 600 + [(None, 0, 0)] * 300 + [(1000 + i, 2, 2) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    key = ["doc_id", "size", "text_crc32"]
    parts = shards._numbered(df, key, 100).selectExpr("pmod(xxhash64(doc_id, _copy), 8) as p", "doc_id", "_copy")
    assert parts.where("doc_id = 7").groupBy("p").count().agg({"count": "max"}).first()[0] < 120
    assert parts.distinct().count() == len(rows)
    got = shards.shuffle_into_shards(df, key, 24, 3, 100, 10, 3).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    hot = np.bincount([r["shard"] for r in got if r["doc_id"] == 7], minlength=24)
    assert hot.min() > 8 and hot.max() < 42
    again = shards.shuffle_into_shards(df.repartition(5), key, 24, 3, 100, 10, 3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_query_against_its_law(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = op8_sharding(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {
        i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()
    }
    assert len(got) == len(docs) and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    slots = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in slots) and sum(map(len, slots)) == len(docs)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1


def test_same_rows_same_shards(spark):
    df = spark.range(500).selectExpr("id as doc_id", "id as size", "id as text_crc32")
    key = ["doc_id", "size", "text_crc32"]
    a = shards.shuffle_into_shards(df, key, 24, 1, 50, 10)
    b = shards.shuffle_into_shards(df.repartition(7), key, 24, 1, 50, 10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_other_columns_stay_whatever_their_names(spark):
    df = spark.range(40).selectExpr("id as doc_id", "null as _mark", "id % 2 as _part", "'x' as _c0", "id as _cell")
    got = shards.shuffle_into_shards(df, ["doc_id"], 3, 1, 10, 5, 2)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(map(tuple, df.collect()))


def test_matrix_has_the_given_sums_and_a_fair_mean():
    parts, cells = np.array([30, 0, 50, 20]), np.array([25, 25, 40, 10])
    total = np.zeros((4, 4))
    for seed in range(300):
        m = np.array([shards.matrix_row(parts, cells, p, seed) for p in range(4)])
        assert (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == cells).all()
        total += m
    assert np.abs(total / 300 - np.outer(parts, cells) / 100).max() < 0.7


def test_every_place_is_as_likely(spark):
    df = spark.range(48).selectExpr("id as doc_id", "0L as size", "0L as text_crc32")
    seen = np.zeros((48, 2))
    for seed in range(20):
        for r in shards.shuffle_into_shards(df, ["doc_id"], 2, seed, 10, 10, 4).collect():
            seen[r["doc_id"], r["shard"]] += 1
    assert abs(seen[:, 0].sum() - 480) < 1 and seen[:, 0].std() < 4


def test_draws_of_any_size():
    rng = np.random.default_rng(1)
    for good, bad, n in [(4 * 10**9, 6 * 10**9, 5 * 10**9), (3, 5 * 10**9, 4 * 10**9), (5 * 10**9, 7, 5 * 10**9)]:
        drawn = [shards.hypergeometric(rng, good, bad, n) for _ in range(200)]
        assert all(max(0, n - bad) <= k <= min(n, good) for k in drawn)
        mean = n * good / (good + bad)
        spread = (mean * bad / (good + bad) * (good + bad - n) / (good + bad)) ** 0.5
        assert abs(np.mean(drawn) - mean) < 5 * spread / 200**0.5 + 0.01
    small = [shards.hypergeometric(rng, 3, 4, 5) for _ in range(500)]
    assert abs(np.mean(small) - 15 / 7) < 0.2
