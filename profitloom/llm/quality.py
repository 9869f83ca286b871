"""Quality rules: repetition inside a text, found with a suffix array over its words.

The words that stand in five-word windows found twice are gathered; a suffix array with longest
common prefixes over that sequence gives every maximal repeated run of words, the union of their
spans and the longest of them. Leaving out the other words loses nothing: a repeated run of five
or more words consists of such windows only.

Null and empty texts have no words, so they fail; a text below ``min_repeat`` words has no
repeats; equal rows are judged alike, each by itself; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from profitloom.llm import ragged
from profitloom.llm.common import batches, record_batch, ship

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_BYTES = 2 << 20
#: Symbols up to which common prefixes are measured on Python lists.
_AS_LIST = 1 << 20

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_repeats long, longest_repeat long, kept boolean"
)
_MEASURES = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("n_repeats", pa.int64()),
        ("longest_repeat", pa.int64()),
        ("kept", pa.bool_()),
    ]
)


@dataclass(frozen=True)
class QualityRules:
    """Limits; the fraction is ``covered_percent`` of a text's words."""

    min_words: int = 10
    min_repeat: int = 5
    covered_percent: int = 20
    longest_words: int = 50


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the longest common prefix of each with the one before it.

    Prefix doubling: the ranks of twice as long prefixes come from pairs of ranks, and only the last
    ranks are kept. Common prefixes are measured in text order afterwards: the one at a place is
    shorter than the one before it by one symbol at most, so the work and the memory grow with the text.
    """
    n = len(symbols)
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    rank, step = symbols + np.int32(1), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n:
        key = rank.astype(np.int64) * (n + 1)
        if step < n:
            key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int32))), dtype=np.int32)
        del key
        step *= 2
    return order, _common_prefixes(symbols, order)


def _common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it."""
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    length = np.zeros(n, np.int32)
    # Small texts as lists, which are faster, large ones where they lie.
    small = n <= _AS_LIST
    text, earlier = (symbols.tolist(), before.tolist()) if small else (memoryview(symbols), memoryview(before))
    out, common = memoryview(length), 0
    for place in range(n):
        other = earlier[place]
        if other < 0:
            common = 0
            continue
        end = n - (place if place > other else other)
        while common < end and text[place + common] == text[other + common]:
            common += 1
        out[place] = common
        if common:
            common -= 1
    return length[order].astype(np.int64)


def repeats(hashes: np.ndarray, rows: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: words in repeated runs of ``least`` words or more, maximal runs, longest run."""
    none = np.zeros(n, np.int64)
    window, at = ragged.windows(hashes, rows, least)
    if not len(at):
        return none, none, none
    key = ragged.mix(window ^ (rows[at].astype(np.uint64) * np.uint64(ragged.BASE_B)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return none, none, none
    del window, key, order, same
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + least, -1)
    place = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    del at, twice, cover
    # The gathered words, with a sign of its own after each run of neighbours in a row.
    gap = np.flatnonzero((np.diff(place) > 1) | (np.diff(rows[place]) > 0)) + 1
    word = np.unique(
        ragged.mix(hashes[place] ^ (rows[place].astype(np.uint64) * np.uint64(ragged.BASE_A))), return_inverse=True
    )[1]
    end = np.append(gap, len(place))
    symbols = np.insert(word.astype(np.int64), end, -1 - np.arange(len(end)))
    owner = np.insert(rows[place], end, rows[place[end - 1]])
    del word, place, gap
    order, lcp = suffix_array(symbols)
    # The deepest common-prefix interval a suffix lies in is the longest run repeated from there.
    deep = np.zeros(len(symbols), np.int64)
    deep[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    del order, lcp
    deep[deep < least] = 0
    maximal = (deep > 0) & (deep > np.append(0, deep[:-1]) - 1)
    start = np.flatnonzero(maximal)
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + deep[start], -1)
    covered = np.cumsum(cover[:-1]) > 0
    longest = none.copy()
    np.maximum.at(longest, owner, deep)
    return ragged.counts(owner[covered], n), ragged.counts(owner[start], n), longest


def _per_row(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are inside."""
    total = np.zeros(len(inside) + 1, np.int32)
    np.cumsum(inside, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def measure(texts: pa.Array, rules: QualityRules) -> list:
    """The columns of ``COLUMNS`` for a batch of texts."""
    data, offsets = ragged.text_buffers(texts)
    n = len(offsets) - 1
    starts, ends, rows = ragged.words(data, offsets)
    hashes = ragged.hash_spans(data, starts, ends)
    n_words = ragged.counts(rows, n)
    word_chars, n_symbols = (_per_row(inside[data], offsets) for inside in (~SPACE_OR_TAIL, SYMBOLS))
    line_start, line_end, line_row = ragged.lines(data, offsets)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = line_row[worded]
    line = ragged.hash_spans(data, line_start[worded], line_end[worded])
    other = ragged.hash_spans(data, line_start[worded], line_end[worded], ragged.BASE_B)
    line = ragged.mix(line ^ ragged.mix(other + line_row.astype(np.uint64)))
    first = np.unique(line, return_index=True)[1]
    n_lines = ragged.counts(line_row, n) - ragged.counts(line_row[first], n)
    del starts, ends, line_start, line_end, worded, line, other, line_row, first
    covered, n_repeats, longest = repeats(hashes, rows, n, rules.min_repeat)
    failed = (n_words < rules.min_words) | (100 * covered > rules.covered_percent * n_words)
    return [
        n_words,
        word_chars,
        n_symbols,
        n_lines,
        covered,
        failed,
        n_repeats,
        longest,
        ~failed & (longest <= rules.longest_words),
    ]


#: White space and the later bytes of a code point.
SPACE_OR_TAIL = ragged.SPACE.copy()
SPACE_OR_TAIL[0x80:0xC0] = True


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each document with its measures and the verdict ``kept``."""
    ship(docs.sparkSession)
    frame = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            schema = pa.schema([*list(batch.schema)[:-1], *_MEASURES])
            yield record_batch(schema, [*kept, *measure(batch.column(batch.num_columns - 1), rules)])

    return frame.mapInArrow(run, f"{fields}, {COLUMNS}")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents that pass, whole and unchanged."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            yield batch.filter(pa.array(measure(batch.column(place), rules)[-1]))

    return docs.mapInArrow(run, docs.schema)
