"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches. A batch's lines are counted by the 128-bit hash of their key; keys
already known to be common are merge-anti-joined away, and the rest is written as a run, sorted by
hash. When a level holds ``fan`` runs they are compacted into one run of the next level; keys that
reach the limit there leave for the common run, which later batches are joined against. At the
end all levels are compacted once more, and each document loses the lines whose key is common.

A line's key is the line without white space at its ends and with A-Z lower-cased; empty keys are
never common. A document counts once for a key. Null and empty texts have one empty line. Equal
rows are documents of their own, null ids too; other columns go through unchanged, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom import storage
from profitloom.llm import ragged
from profitloom.llm.common import batches, record_batch, ship

_BYTES = 2 << 20
#: Bytes of common hashes up to which they are handed to every task; beyond it they are joined.
BROADCAST_BYTES = 64 << 20
KEYS = ["_h1", "_h2"]
_RUN = "_h1 long, _h2 long, _n long"
_RUN_ARROW = pa.schema([("_h1", pa.int64()), ("_h2", pa.int64()), ("_n", pa.int64())])


def line_keys(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of lines, the two hashes of their keys, and whether a key is empty."""
    starts, ends, rows = ragged.lines(data, offsets)
    left, right = ragged.strip(~ragged.SPACE[data], starts, ends)
    folded = ragged.LOWER[data]
    first = ragged.hash_spans(folded, left, right)
    second = ragged.hash_spans(folded, left, right, ragged.BASE_B)
    return starts, ends, rows, first, second, right == left


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct tuple, and how often it is there."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def line_counts(docs: DataFrame, text: str) -> DataFrame:
    """In how many of the documents each line key is, partly summed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            _, _, rows, a, b, empty = line_keys(*ragged.text_buffers(batch.column(0)))
            rows, a, b = rows[~empty], a[~empty], b[~empty]
            once, _ = _groups(rows, a, b)
            a, b = a[once], b[once]
            key, n = _groups(a, b)
            yield record_batch(_RUN_ARROW, [a[key].view(np.int64), b[key].view(np.int64), n.astype(np.int64)])

    return docs.select(docs[text].alias("_text")).mapInArrow(run, _RUN)


@dataclass
class LineRuns:
    """The runs so far. ``least`` documents make a key common."""

    spark: SparkSession
    least: int = 10
    fan: int = 4
    levels: list[list[str]] = field(default_factory=list)
    compacted: list[str] = field(default_factory=list)

    def _read(self, folders: list[str], common: bool) -> DataFrame:
        """Rows of some runs: those below the limit, or those that reached it there."""
        rows = self.spark.createDataFrame([], f"{_RUN}, _common boolean")
        for folder in folders:
            rows = rows.union(self.spark.read.schema(rows.schema).parquet(folder))
        return rows.where("_common" if common else "not _common").drop("_common")

    def _write(self, run: DataFrame) -> str:
        folder = storage.new_folder(self.spark, "line-run")
        run.sortWithinPartitions("_common", *KEYS).write.partitionBy("_common").parquet(folder)
        return folder

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Take in a batch of documents."""
        ship(self.spark)
        run = line_counts(docs, text).groupBy(*KEYS).agg(F.sum("_n").alias("_n"))
        if self.compacted:
            run = run.join(self._read(self.compacted, True), KEYS, "left_anti")
        self._place(0, self._write(run.withColumn("_common", F.lit(False))))

    def _place(self, level: int, folder: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(folder)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._compact(runs))

    def _compact(self, runs: list[str]) -> str:
        """Merge runs into one; keys that are common are marked and take no part from here on."""
        merged = self._read(runs, False).groupBy(*KEYS).agg(F.sum("_n").alias("_n"))
        folder = self._write(merged.withColumn("_common", F.col("_n") >= self.least))
        self.compacted.append(folder)
        return folder

    def common(self) -> DataFrame:
        """Hashes of the keys that are in ``least`` documents or more."""
        runs = [r for level in self.levels for r in level]
        self.levels = [[self._compact(runs)]] if runs else []
        return self._read(self.compacted, True).select(*KEYS)


def _kept(batch: pa.RecordBatch, place: int, drop: np.ndarray, starts, ends, rows) -> list:
    """The batch's columns with the text replaced, and the numbers of lines and of dropped lines."""
    data, _ = ragged.text_buffers(batch.column(place))
    n = batch.num_rows
    total, dropped = ragged.counts(rows, n), ragged.counts(rows[drop], n)
    texts = batch.column(place).fill_null("").to_pylist() if dropped.any() else None
    columns = list(batch.columns[:place]) + [batch.column(place).fill_null("")] + list(batch.columns[place + 1 :])
    if texts is not None:
        raw = data.tobytes()
        first = np.searchsorted(rows, np.arange(n + 1))
        for row in np.flatnonzero(dropped):
            stay = [i for i in range(first[row], first[row + 1]) if not drop[i]]
            texts[row] = b"\n".join(raw[starts[i] : ends[i]] for i in stay).decode()
        columns[place] = pa.array(texts, batch.schema.field(place).type)
    return [*columns, total, dropped]


_MORE = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _answer(batch: pa.RecordBatch, columns: list, report: bool) -> pa.RecordBatch:
    schema = pa.schema([*batch.schema, *_MORE]) if report else batch.schema
    return record_batch(schema, columns[: len(schema)])


def drop_lines(
    docs: DataFrame, common: DataFrame, text: str = "text", bound: int = BROADCAST_BYTES, report: bool = True
) -> DataFrame:
    """The documents' columns with the text without common lines; with ``report`` n_lines and n_dropped too.

    The common hashes go to every task while they are ``bound`` bytes at most; beyond that they
    are joined with the lines of each distinct text.
    """
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if report:
        fields += ", n_lines long, n_dropped long"
    if common.count() * 16 > bound:
        return _drop_joined(docs, common, place, fields, report)
    found = common.toPandas().sort_values(KEYS)
    known = spark.sparkContext.broadcast(tuple(found[k].to_numpy().view(np.uint64) for k in KEYS))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = known.value
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        for batch in batches(source, _BYTES):
            starts, ends, rows, a, b, empty = line_keys(*ragged.text_buffers(batch.column(place)))
            drop = np.zeros(len(a), bool)
            if len(first):
                low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
                while (live := np.flatnonzero(low < high)).size:
                    drop[live] |= second[low[live]] == b[live]
                    low[live] += 1
            yield _answer(batch, _kept(batch, place, drop & ~empty, starts, ends, rows), report)

    return docs.mapInArrow(run, fields)


def _drop_joined(docs: DataFrame, common: DataFrame, place: int, fields: str, report: bool) -> DataFrame:
    """``drop_lines`` for any number of common lines."""
    text = docs.columns[place]
    whole = "_t1 long, _t2 long"

    def text_hash(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
        data, offsets = ragged.text_buffers(batch.column(at))
        bases = (ragged.BASE_A, ragged.BASE_B)
        return [ragged.hash_spans(data, offsets[:-1], offsets[1:], b).view(np.int64) for b in bases]

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("_t1", "_t2", *KEYS, "_line")])
        for batch in batches(source, _BYTES):
            key = text_hash(batch, 0)
            _, _, rows, a, b, empty = line_keys(*ragged.text_buffers(batch.column(0)))
            line = np.arange(len(rows)) - np.searchsorted(rows, rows)
            some = ~empty
            columns = [key[0][rows], key[1][rows], a.view(np.int64), b.view(np.int64), line]
            yield record_batch(schema, [c[some] for c in columns])

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            schema = pa.schema([*batch.schema, ("_t1", pa.int64()), ("_t2", pa.int64())])
            yield record_batch(schema, [*batch.columns, *text_hash(batch, place)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            starts, ends, rows = ragged.lines(*ragged.text_buffers(batch.column(place)))
            drop = np.zeros(len(rows), bool)
            first = np.searchsorted(rows, np.arange(batch.num_rows))
            for row, at in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if at:
                    drop[first[row] + np.array(at)] = True
            plain = batch.select(range(batch.num_columns - 1))
            yield _answer(plain, _kept(plain, place, drop, starts, ends, rows), report)

    found = (
        docs.select(docs[text].alias("_text"))
        .mapInArrow(listed, f"{whole}, _h1 long, _h2 long, _line long")
        .join(common, KEYS, "left_semi")
        .groupBy("_t1", "_t2")
        .agg(F.collect_set("_line").alias("_lines"))
    )
    # Columns go by place here, whatever their names.
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    whole_docs = docs.toDF(*names).mapInArrow(hashed, f"{kinds}, {whole}").join(found, ["_t1", "_t2"], "left")
    return whole_docs.select(*names, "_lines").mapInArrow(run, fields)


def dedup(
    docs: DataFrame, text: str = "text", least: int = 10, n_batches: int = 4, fan: int = 2,
    bound: int = BROADCAST_BYTES, report: bool = True,
) -> DataFrame:
    """``drop_lines`` with the lines common in these documents, taken in as ``n_batches`` batches."""
    runs = LineRuns(docs.sparkSession, least, fan)
    for b in range(n_batches):
        runs.add(docs.where(F.pmod(F.xxhash64(docs[text]), F.lit(n_batches)) == b), text)
    return drop_lines(docs, runs.common(), text, bound, report)
