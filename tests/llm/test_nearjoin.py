"""Jaccard join against all pairs, components against a union-find."""

import random

import numpy as np
import pytest

import plain
from profitloom.llm import nearjoin
from profitloom.llm.components import components

DOCS = "doc_id long, text string, n_shingles string, component_id int"


def copies(seed=1, groups=25):
    """Groups of near copies, chains at the threshold, exact copies, a passage all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(30)]
    out = [None, "", " \n", "One", "one", "one two", "ONE two", "one two three four five"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 12, 40, 90]))] + rng.choice([[], passage])
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text
            out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in text))
    return out + out[20:30]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 2_000_000), (5, 80, 2_000_000), (4, 85, 300), (3, 60, 150)])
def test_components_equal_all_pairs(spark, words, percent, block):
    texts = copies()
    got = nearjoin.join(docs_of(spark, texts), nearjoin.JaccardRule(words, percent), block=block).collect()
    want = plain.components(list(enumerate(texts)), words, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(texts)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(plain.shingles(t, words)) for i, t in enumerate(texts)}
    assert len(set(want.values())) < len(texts) - 20


def test_rows_with_one_id_are_one_vertex_and_null_ids_reach_the_smallest(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(9, a), (3, a), (9, b), (5, b), (None, b), (None, c), (7, None), (7, ""), (8, "")]
    got = nearjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got), key=str)
    want = [(9, True, 3), (3, True, 3), (9, True, 3), (5, True, 3), (None, True, 3), (None, True, None)]
    want += [(7, False, 7), (7, False, 7), (8, False, 8)]
    assert found == sorted(want, key=str)


def test_one_document_of_each_group_stays(spark):
    texts = copies(4, 10)
    docs = docs_of(spark, texts)
    kept = nearjoin.keep_one(docs)
    want = plain.components(list(enumerate(texts)), 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in want if want[i] == i]
    assert nearjoin.keep_one(docs.limit(0)).count() == 0


def test_large_group_is_linked_without_comparing_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for _ in range(400):
        own = base.copy()
        own[rng.integers(0, 200, 5)] = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        sets.append(np.unique(own))
    seen = []
    compare = nearjoin.Links.compare
    monkeypatch.setattr(nearjoin.Links, "compare", lambda self, i, j: (seen.append(self.find(i) != self.find(j)), compare(self, i, j)))
    edges = nearjoin.link_group(sets, 85)
    assert len(edges) == 399 and sum(seen) < 2000


@pytest.mark.parametrize("seed", range(3))
def test_traversal_finds_what_all_pairs_find(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(120)]
    links = nearjoin.Links(sets, 40)
    for i, j in nearjoin.link_group(sets, 40):
        links.compare(i, j)
    all_pairs = nearjoin.Links(sets, 40)
    for i in range(120):
        for j in range(i):
            all_pairs.compare(i, j)
    assert links.labels().tolist() == all_pairs.labels().tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 400), (7, 7)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_tied_by_a_passage_alone_are_not_compared_block_by_block(spark, monkeypatch):
    """The large cluster that a common passage makes is dealt again; texts that link stay together."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(24)]
    texts = [" ".join([word() for _ in range(40)] + passage) for _ in range(60)]
    texts += [" ".join([word(), *texts[0].split()[1:]]), " ".join([*texts[7].split()[:-1], word()])]
    travelled, link = [], nearjoin._link_groups
    monkeypatch.setattr(nearjoin, "_link_groups", lambda rows, rule: travelled.append(rows.count()) or link(rows, rule))
    got = nearjoin.join(docs_of(spark, texts), nearjoin.JaccardRule(5, 80), block=300).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(list(enumerate(texts)), 5, 80)
    assert sum(r["component_id"] != r["doc_id"] for r in got) == 2
    assert 4 <= sum(travelled) < len(texts)


def test_tokens_and_nodes_travel_in_few_bytes():
    values = np.array([0, 1, 255, 256, nearjoin.NODE_MASK, 12345678901], np.uint64)
    assert nearjoin._wide(nearjoin._low(values)).tolist() == values.tolist()
    assert len(nearjoin._low(values)) == 5 * len(values)
