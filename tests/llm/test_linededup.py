"""Line dedup against counting in plain Python."""

import random

import pytest

import plain
from profitloom.llm import linededup

DOCS = "doc_id long, text string, n_lines string, `_line` int"


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    common = ["Shared line", "  shared LINE\t", "Éa", "", "x", " ", "tail\x0b"]
    out = [None, "", "\n", "Shared line", "shared line\nshared line", "a\n" * 3000]
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.3 else f"own {i} {rng.randrange(9)}" for _ in range(rng.randrange(9))]
        out.append("\n".join(lines))
    return out + out[10:20]


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("fan", [2, 3])
def test_lines_go_as_counted(spark, bound, fan):
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 7 else None, t, str(i), 1) for i, t in enumerate(texts)], DOCS)
    got = linededup.dedup(docs.withColumnRenamed("n_lines", "row"), least=10, fan=fan, bound=bound).collect()
    want = plain.drop_lines(texts, 10)
    assert len(got) == len(texts)
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in sorted(got, key=lambda r: int(r["row"]))] == want
    assert any(d for _, d, _ in want)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_other_columns_stay_whatever_their_names(spark, bound):
    docs = spark.createDataFrame([(i, "same", "n", i) for i in range(12)], DOCS)
    got = linededup.dedup(docs, least=10, bound=bound, report=False)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, "", "n", i) for i in range(12)]


def test_runs_across_batches_equal_one_batch(spark):
    texts = corpus(3, 60)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, many = linededup.LineRuns(spark, 5), linededup.LineRuns(spark, 5, fan=2)
    one.add(docs)
    for k in range(7):
        many.add(docs.where(f"doc_id % 7 = {k}"))
    assert len(many.compacted) > 2
    assert sorted(map(tuple, one.common().collect())) == sorted(map(tuple, many.common().collect()))


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], DOCS), report=False).count() == 0
