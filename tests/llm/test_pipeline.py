"""The pipeline against plain Python, stage by stage."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
import plain
from profitloom.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def by_hand(rows, items):
    """(id, text) that reach the last stage."""
    rows = [(i, t) for i, t in rows if plain.quality(t)[3]]
    rows = [(i, t) for (i, _), (_, _, t) in zip(rows, plain.drop_lines([t for _, t in rows], corpus_pipeline.LINE_DOCUMENTS))]
    first = plain.components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if first[i] == i]
    return [(i, t) for i, t in rows if not any(plain.leaks(t, x) for x in items)]


def test_run_equals_plain_python(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect()]
    items = [r["text"] for r in table(spark, SF_DIR, "benchmark").collect()]
    want = by_hand(docs, items)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert sorted(got) == sorted(i for i, _ in want) and 0 < len(want) < len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(got[i]["piece_ids"]) == library.encode(t) and got[i]["round_trip"] for i, t in want)


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (2, good), (None, good + " x y"), (3, None), (4, ""), (5, good + " other\nline"), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "c") for i, t in rows], schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF_DIR)
            assert out.columns == docs.columns, name
            assert out.count() <= frame.count()
        corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).count()
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert corpus_pipeline.line_dedup(spark, docs, SF_DIR).where("doc_id = 5").first()["n_chars"] == len(rows[5][1])


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    good, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [
        (7, good, "x"), (7, good, "y"), (7, good, "x"), (9, good + " more", "x"), (None, good, "x"),
        (None, other, "x"), (None, other, "x"), (None, other + " more", "y"), (5, third, "x"), (None, None, "x"), (None, "", "x"),
        (5, " \n", "x"), (5, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _vertex string")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF_DIR)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    assert sorted(r[0] for r in out if r[1] == good) == [7] and (5, third, "x") in out
    assert len([r for r in out if r[1] and r[1].startswith("b0")]) == 1
    assert sorted(map(str, (r for r in out if not (r[1] or "").strip()))) == sorted(map(str, (r for r in rows if not (r[1] or "").strip())))
    assert len(out) == 7
