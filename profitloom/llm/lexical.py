"""Ranked lexical search by bag deduplication.

Documents are cut down to the items' vocabulary: a document's bag is its vector of term counts over that
vocabulary. Documents with the same bag and the same length figure ``m`` get the same score for every
item, so they are one class. Classes are found by hash and told apart by their bags' bytes, scored once, and
the best of each item are expanded into their members by ascending id. Each class stands for its smallest
id while the best are sought: any class behind ``top`` others has ``top`` documents before it.

The corpus's texts are read once for a slice of items; a slice's vocabulary is ``ITEM_BYTES`` at most,
and more items take more slices. Inside a task only the terms that a class and an item share are
touched, and every task hands on the best ``top`` classes of each item. Members of the classes found
are cut to the first ``top`` of each on the way to their ranks, so a class of very many copies is
no load on one task.

Null and empty texts have no terms and are found by nothing; an item without terms finds nothing; repeated
rows are documents each, repeated items are searched each; a document without id comes after others of
equal score; an empty table has no results; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profitloom.llm import ragged
from profitloom.llm.common import batches, record_batch, ship, stored

#: Bytes of item texts that one pass over the corpus serves.
ITEM_BYTES = 16 << 20
#: Bytes of selected bags up to which they are broadcast; beyond it they are joined.
BROADCAST_BYTES = 32 << 20
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = np.zeros(256, bool)
_INSIDE[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True
_INSIDE[0x80:] = True
_TEXT_BYTES, _BAG_BYTES, _CELLS, _PARTS = 2 << 20, 4 << 20, 1 << 21, 1 << 20
_EXACT = 1 << 53


@dataclass(frozen=True)
class Vocabulary:
    """Distinct terms as bytes side by side, with hashes in ascending order to find them by."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(terms: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in terms], np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = ragged.hash_spans(data, end - size, end)
        order = np.argsort(hashes, kind="stable")
        return Vocabulary(data, end - size, end, hashes[order], order)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the term that each span holds, -1 for none; hashes propose, bytes decide."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return out
        hashes = ragged.hash_spans(data, start, end)
        low = np.searchsorted(self.hashes, hashes)
        high = np.searchsorted(self.hashes, hashes, "right")
        step = 0
        # More than one round only where terms of the vocabulary share a hash.
        while len(open_ := np.flatnonzero((low + step < high) & (out < 0))):
            term = self.order[low[open_] + step]
            alike = same_bytes(data, start[open_], end[open_], self.data, self.start[term], self.end[term])
            out[open_[alike]] = term[alike]
            step += 1
        return out


def same_bytes(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays are equal, pair by pair; no span is empty."""
    size = a1 - a0
    same = size == b1 - b0
    pair = np.flatnonzero(same)
    size = size[pair]
    if len(pair):
        first = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(first, size)
        equal = a[np.repeat(a0[pair], size) + inner] == b[np.repeat(b0[pair], size) + inner]
        same[pair] = np.logical_and.reduceat(equal, first)
    return same


def terms_of(text: str | None) -> list[bytes]:
    return [t.encode() for t in _TERM.findall((text or "").translate(_LOWER))]


def bags(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, pa.Array]:
    """Number of terms of each text, and its bag: the term numbers as steps, then their counts, in 32 bits each."""
    data, offsets = ragged.text_buffers(texts)
    n = len(offsets) - 1
    data = ragged.LOWER[data]
    start, end, row = ragged.spans(_INSIDE[data], offsets)
    length = ragged.counts(row, n)
    term = vocabulary.find(data, start, end)
    size = max(len(vocabulary.order), 1)
    held, count = np.unique(row[term >= 0] * size + term[term >= 0], return_counts=True)
    row, term = held // size, held % size
    entries = ragged.counts(row, n)
    last = np.cumsum(entries)
    step = np.diff(term, prepend=0)
    first = (last - entries)[entries > 0]
    step[first] = term[first]
    place = np.arange(len(term)) + np.repeat(last - entries, entries)
    flat = np.zeros(2 * len(term), np.uint32)
    flat[place] = step
    flat[place + np.repeat(entries, entries)] = count
    offset = np.concatenate(([0], np.cumsum(8 * entries))).astype(np.int32)
    return length, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offset.tobytes()), pa.py_buffer(flat.tobytes())])


def entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all entries of a column of bags."""
    data, offsets = ragged.text_buffers(column)
    flat = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
    size = np.diff(offsets) // 8
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) + np.repeat(np.cumsum(size) - size, size)
    total = np.concatenate(([0], np.cumsum(flat[at])))
    base = total[np.cumsum(size) - size]
    return row, total[1:] - np.repeat(base, size), flat[at + np.repeat(size, size)]


@dataclass
class Postings:
    """For each term the items that hold it, each with the term's weight times its occurrences there."""

    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    n_items: int
    #: Whether sums are whole in doubles; if not, halves of 26 bits are added up apart.
    exact: bool

    @staticmethod
    def of(items: list[list[bytes]], number: dict[bytes, int], weight: np.ndarray) -> Postings:
        rows = sorted((number[t], i, n) for i, terms in enumerate(items) for t, n in Counter(terms).items())
        term, item, times = np.array(rows, np.int64).reshape(-1, 3).T
        total = weight[term] * times
        most = np.bincount(item, total * 1e6, minlength=1).max() if len(item) else 0
        first = np.searchsorted(term, np.arange(len(number) + 1))
        return Postings(first, item, total, len(items), bool(most < _EXACT / 2))

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores of ``n`` classes for all items, from the classes' entries."""
        size = self.first[term + 1] - self.first[term]
        cells = np.zeros(n * self.n_items, np.int64)
        stop = np.cumsum(size)
        at = 0
        while at < len(row):
            # Entries whose postings fill a part.
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + _PARTS, "right")))
            part = size[at:to]
            inner = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            post = np.repeat(self.first[term[at:to]], part) + inner
            cell = np.repeat(row[at:to] * self.n_items, part) + self.item[post]
            value = self.weight[post] * np.repeat(impact[at:to], part)
            if self.exact:
                cells += np.bincount(cell, value, minlength=len(cells)).astype(np.int64)
            else:
                np.add.at(cells, cell, value)
            at = to
        return cells.reshape(n, self.n_items)


class Best:
    """The ``top`` classes of each item so far, by score, then by smallest id."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score, self.id, self.no = (np.zeros(0, np.int64) for _ in range(4))
        self.missing = np.zeros(0, bool)
        self.least = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, no: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        found = np.concatenate((self.id, ids[row]))
        gone = np.concatenate((self.missing, missing[row]))
        number = np.concatenate((self.no, no[row]))
        order = np.lexsort((number, found, gone, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.top]
        self.item, self.score, self.id, self.missing, self.no = (x[order] for x in (item, score, found, gone, number))
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.top)
        last = np.searchsorted(self.item, full, "right") - 1
        self.least[full] = self.score[last]


def _restricted(docs: DataFrame, vocabulary: Vocabulary, text: str, key: str) -> DataFrame:
    """(_id, _n, _bag) of all documents with any term."""
    frame = docs.select(docs[key].cast("bigint").alias("_id"), docs[text].alias("_text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_bag", pa.binary())])
        for batch in batches(source, _TEXT_BYTES):
            n, bag = bags(batch.column(1), vocabulary)
            yield record_batch(schema, [batch.column(0), pa.array(n), bag]).filter(pa.array(n > 0))

    return frame.mapInArrow(run, "_id long, _n long, _bag binary")


def _document_counts(held: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is; added up in each task first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches(source, _BAG_BYTES):
            total += np.bincount(entries_of(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(total)
        yield record_batch(pa.schema([("t", pa.int64()), ("df", pa.int64())]), [pa.array(some), pa.array(total[some])])

    out = np.zeros(size, np.int64)
    # One row a term of the slice's vocabulary, which is bounded.
    for term, df in held.select("_bag").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _scored(classes: DataFrame, postings: Postings, top: int) -> DataFrame:
    """(_item, _score, _first, _no): the best classes of each item in each task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(postings.n_items, top)
        rows = max(1, _CELLS // max(postings.n_items, 1))
        for batch in batches(source, _BAG_BYTES):
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                number, first, m, bag = part.columns
                row, term, tf = entries_of(bag)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m.to_numpy(zero_copy_only=False)[row])
                ids = first.fill_null(0).to_numpy(zero_copy_only=False)
                missing = first.is_null().to_numpy(zero_copy_only=False)
                best.add(postings.scores(part.num_rows, row, term, impact), ids, missing, number.to_numpy(zero_copy_only=False))
        schema = pa.schema([("_item", pa.int64()), ("_score", pa.int64()), ("_first", pa.int64()), ("_no", pa.int64())])
        yield record_batch(schema, [best.item, best.score, pa.array(best.id, mask=best.missing), best.no])

    return classes.select("_no", "_first", "_m", "_bag").mapInArrow(run, "_item long, _score long, _first long, _no long")


def _first_of(frame: DataFrame, by: str, top: int, *order, name: str = "_place") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return frame.withColumn(name, place).where(F.col(name) <= top)


def classes_of(docs: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their ``_m`` and the hash of their class, and the classes (_no, _hash, _m, _bag, _first)."""
    keyed = docs.where("octet_length(_bag) > 0").selectExpr(
        "_id", "_bag", f"100 - 25 + ((25L * _n * {n_docs}L) div {n_terms}L) as _m", "xxhash64(_bag, _m) as _hash"
    )
    # Grouping by the bag's bytes besides the hash tells classes apart that only share the hash.
    same = keyed.groupBy("_hash", "_m", "_bag").agg(F.min("_id").alias("_first"))
    numbered = same.withColumn("_no", F.monotonically_increasing_id())
    return keyed, stored(docs.sparkSession, numbered, "search-classes")


def _search_slice(docs: DataFrame, items: list, top: int, text: str, key: str) -> DataFrame | None:
    """Results (_item, rank, key, score) for items given as (number, text); None if nothing can be found."""
    spark = docs.sparkSession
    terms = [terms_of(t) for _, t in items]
    vocabulary = sorted({t for ts in terms for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    held = stored(spark, _restricted(docs, Vocabulary.of(vocabulary), text, key), "search-bags")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_docs or not vocabulary:
        return None
    df = _document_counts(held, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    keyed, classes = classes_of(held, n_docs, n_terms)
    found = _scored(classes, Postings.of(terms, number, weight), top)
    order = [F.desc("_score"), F.asc_nulls_last("_first"), F.asc("_no")]
    found = stored(spark, _first_of(found, "_item", top, *order).drop("_place", "_first"), "search-found")
    chosen = stored(
        spark, classes.join(found.select("_no").distinct(), "_no", "left_semi").select("_no", "_hash", "_m", "_bag"), "search-chosen"
    )
    weight_of = chosen.agg(F.sum(F.octet_length("_bag") + 64)).first()[0] or 0
    members = keyed.join(F.broadcast(chosen) if weight_of <= BROADCAST_BYTES else chosen, ["_hash", "_m", "_bag"])
    members = _first_of(members.select("_no", "_id"), "_no", top, F.asc_nulls_last("_id")).drop("_place")
    ranked = _first_of(found.join(members, "_no"), "_item", top, F.desc("_score"), F.asc_nulls_last("_id"), name="rank")
    return ranked.select("_item", "rank", F.col("_id").alias(key), F.col("_score").alias("score"))


def search(
    docs: DataFrame, items: DataFrame, top: int = 20, text: str = "text", key: str = "doc_id",
    item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """``item_key``, rank, ``key`` and score of the ``top`` best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    ship(spark)
    listed = items.select(items[item_key].alias("_key"), items[item_text].alias("_text"), F.monotonically_increasing_id().alias("_item"))
    listed = stored(spark, listed, "search-items")
    size = listed.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 16)).first()[0] or 0
    slices = -(-size // ITEM_BYTES)
    found = []
    for k in range(slices):
        # A slice holds ITEM_BYTES or so, as items are dealt by hash.
        rows = listed.where(F.pmod(F.xxhash64("_item"), F.lit(slices)) == k).select("_item", "_text").collect()
        part = _search_slice(docs, rows, top, text, key) if rows else None
        if part is not None:
            numbers = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], "_item long, _of long")
            found.append(part.join(numbers, "_item").drop("_item").withColumnRenamed("_of", "_item"))
    if not found:
        none = docs.limit(0).select(F.lit(1).alias("rank"), docs[key].cast("bigint").alias(key), F.lit(0).cast("bigint").alias("score"))
        return listed.limit(0).select(F.col("_key").alias(item_key)).crossJoin(none)
    return reduce(DataFrame.union, found).join(listed.select("_item", "_key"), "_item").select(
        F.col("_key").alias(item_key), "rank", key, "score"
    )
