"""Quality rules, token counts and pieces against plain Python and the tokenizers' libraries."""

import hashlib
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import plain
from profitloom.llm import quality, tokens, wordpieces

DOCS = "doc_id long, text string, n_words string, `_text` int, kept string"
ODD = [
    None, "", " ", "\n\n", "one", "a b c d e", "x " * 400, ("a b c d e f " * 3).strip(), "é" * 5000,
    "word " * 9, "#*$%&|<> " * 12, "l1 a\nl1 a\nl2\n\nl2", "A\u00a0b\u2003c", "\x1c\x1d tab\tend", "ab" * 30000,
]


def frame(spark, texts, first=0):
    """Rows with clashing further columns; the last row is there twice, once without id."""
    rows = [(first + i, t, "x", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, *rows[-1][1:])], DOCS)


def mixed(seed, n, size, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]


def repeated(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(words) + 1)
            words[rng.randrange(len(words) + 1) : 0] = words[a : a + rng.randrange(70)]
        out.append(" ".join(words))
    return out


def test_quality_equals_counting_windows(spark):
    texts = ODD + repeated(1, 300) + [" ".join(f"w{i % 60}x{i // 60 % 2}" for i in range(600))]
    got = quality.judge(frame(spark, texts)).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(texts) + 2
    for i, text in enumerate(texts):
        r = by_id[i]
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain.quality(text), text
    kept = quality.keep_good(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "n_words", "_text", "kept"]
    assert kept.count() == sum(r["kept"] for r in got)


def test_longest_repeat_is_found_to_the_word():
    words = [f"w{i}" for i in range(90)]
    text = " ".join(["s", *words[:60], "t", *words[:60], "u", *[f"v{i}" for i in range(600)]])
    columns = quality.measure(pa.array([text]), quality.QualityRules())
    assert [c[0] for c in columns[4:]] == [120, False, 2, 60, False]


LETTERS = [*"aab \n\t\r\x1c\x85\xa0　é中日'sdl1٣½#!", "́", "\u200b", "\U0001f600", "<|endoftext|>", "'ll", "  ", "the ", "aaaaaaa", "▁"]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + mixed(2, 300, 60, LETTERS) + mixed(3, 200, 60, [x for x in LETTERS if max(x) < "Ā"])
    library = Tokenizer.from_file(path)
    got = tokens.count_tokens(frame(spark, texts), path, 512).where("doc_id is not null").distinct().collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_pieces_equal_the_library_and_decode(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    more = mixed(4, 300, 60, LETTERS) + mixed(5, 300, 90, "abcdefghilmnorstuw") + [" " * 90 + "x", "a" * 3000]
    texts = ODD + more
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = wordpieces.encode_documents(frame(spark, texts), path).where("doc_id is not null").distinct().collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert list(r["piece_ids"]) == library.encode(text), text[:50]
        decoded = text.replace("▁", " ").encode()
        assert r["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()
        assert r["round_trip"] == ("▁" not in text) and r["n_pieces"] == len(r["piece_ids"])


@pytest.mark.parametrize("run", [
    lambda d: quality.judge(d),
    lambda d: tokens.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), 512),
    lambda d: wordpieces.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_state_kept_between_batches_is_bounded(monkeypatch):
    bpe = tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "_KEPT", 3)
    first = [bpe.count([t]) for t in ("one two three four", "five six seven")]
    assert first == [bpe.count([t]) for t in ("one two three four", "five six seven")]
    pieces = wordpieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(wordpieces, "_KEPT", 3)
    once = [pieces.encode([t])[0].tolist() for t in ("one two three four", "five six seven")]
    assert once == [pieces.encode([t])[0].tolist() for t in ("one two three four", "five six seven")]


def test_suffix_array_equals_sorting(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 50, 300):
        for kinds in (1, 2, 5):
            text = [rng.randrange(kinds) for _ in range(n)]
            order, common = quality.suffix_array(np.array(text, np.int64))
            want = sorted(range(n), key=lambda i: text[i:])
            assert order.tolist() == want
            for at in range(1, n):
                a, b = text[want[at - 1] :], text[want[at] :]
                assert common[at] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_memory_of_a_long_repetitive_text_grows_with_it():
    def peak(size):
        tracemalloc.start()
        quality.measure(pa.array(["a b " * (size // 4)]), quality.QualityRules())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(1 << 20) < 80 << 20
    assert peak(2 << 20) < 160 << 20


def test_relaxing_by_place_by_edge_and_in_small_indexes_is_the_same(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", *mixed(7, 60, 90, LETTERS), *mixed(8, 30, 300, "abcdefghijklmnop"), "ab" * 700, "e" * 999]
    want = [library.encode(t) for t in texts]
    for few, suffixes, edges in ((0, 64, 1), (3, 7, 5), (10**6, 1 << 20, 100)):
        for name, value in (("_FEW", few), ("_SUFFIXES", suffixes), ("_EDGES", edges)):
            monkeypatch.setattr(wordpieces, name, value)
        pieces = wordpieces.load(path)
        pieces.reset()
        ids, sizes = pieces.encode(texts)
        ends = np.cumsum(sizes)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == want
    pieces.reset()


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "the"])
def test_a_word_of_a_megabyte(letters):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    word = "".join(rng.choice(letters) for _ in range(1 << 20)) if len(letters) > 3 else letters * ((1 << 20) // len(letters))
    pieces = wordpieces.load(path)
    pieces.reset()
    start = time.time()
    ids, _ = pieces.encode([word])
    print(f"{letters}: {time.time() - start:.1f} s")
    assert time.time() - start < 60
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(word)
    pieces.reset()

