"""Sharding by a uniform shuffle with exact sizes.

Rows are dealt into source parts by hash, equal rows by their number too: they are counted first and
numbered when they are written out again, so copies of one row spread over all parts. How many rows of each part go to each cell (a slice of a
shard) is drawn exactly: the matrix of a uniform shuffle has multivariate hypergeometric rows for
fixed part and cell sizes. It is drawn by halving the parts again and again, each halving from its
own seed, so a task draws only the row it needs and nothing but the part sizes is shared. Each
part is permuted and cut by its counts, the pieces are exchanged, and each cell is permuted again.

Shard counts differ by one at most, and slots run from 0 without gaps. A null text has no bytes,
and crc32 0; null ids, empty texts and equal rows are rows like any other; an empty table has no
rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom.llm.common import record_batch, ship

_NUMPY_MOST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good; any sizes."""
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return n if bad == 0 else good
    if max(good, bad, n) < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    # By inversion on the probabilities within twelve deviations of the mean.
    total = good + bad
    mean = n * (good / total)
    wide = 12 * math.sqrt(max(mean * (bad / total) * ((total - n) / total), 1)) + 12
    low, high = max(0, n - bad, int(mean - wide)), min(n, good, int(mean + wide) + 1)
    k = np.arange(low, high, dtype=np.float64)
    log = np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))
    weight = np.exp(np.concatenate(([0.0], log)) - max(0.0, log.max(initial=0.0)))
    total_weight = np.cumsum(weight)
    return low + int(np.searchsorted(total_weight, rng.random() * total_weight[-1], "right"))


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """Rows of each cell among ``n`` drawn from cells of these sizes."""
    out, rest = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        out[i] = hypergeometric(rng, size, rest, n)
        n -= int(out[i])
    return out


def matrix_row(part_sizes: np.ndarray, cell_sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows for each cell."""
    low, high, cells = 0, len(part_sizes), cell_sizes
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split(rng, cells, int(part_sizes[low:middle].sum()))
        low, high, cells = (low, middle, left) if part < middle else (middle, high, cells - left)
    return cells


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Sizes of ``cells`` cells a shard, shard after shard; shards are equal up to one row."""
    shard = rows // shards + (np.arange(shards) < rows % shards)
    return (shard[:, None] // cells + (np.arange(cells) < shard[:, None] % cells)).ravel()


def _numbered(rows: DataFrame, known: list[str], most: int) -> DataFrame:
    """The rows with ``_copy``, which numbers equal rows from 0 on; no task holds all copies of one."""
    others = [F.first(c).alias(c) for c in rows.columns if c not in known]
    counted = rows.groupBy(*known).agg(F.count(F.lit(1)).alias("_copies"), *others)
    # Many copies are written out in runs, and each run by a task of its own.
    runs = counted.select("*", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {most})")).alias("_run"))
    largest = rows.groupBy(*known).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        runs = runs.repartition(*known, "_run")
    places = F.expr(f"sequence(_run * {most}, least((_run + 1) * {most}, _copies) - 1)")
    return runs.select(*rows.columns, F.explode(places).alias("_copy"))


def shuffle_into_shards(
    rows: DataFrame, identity: list[str], shards: int, seed: int = 0, part_rows: int = 1_000_000, cell_rows: int = 1_000_000, least_parts: int = 32
) -> DataFrame:
    """The rows with ``shard`` and ``slot``.

    ``identity`` names the columns that put the rows of a part in a fixed order; they must tell
    all rows that differ apart, so rows equal in them are one row and its count. ``part_rows`` and ``cell_rows`` bound what a task permutes: it
    holds that many whole numbers, rows stream by.
    """
    spark = rows.sparkSession
    ship(spark)
    total = rows.count()
    n_parts = max(least_parts, math.ceil(total / part_rows))
    cells = max(1, math.ceil(total / shards / cell_rows))
    # Columns go by place here, whatever their names.
    names = [f"_c{i}" for i in range(len(rows.columns))]
    by_name = dict(zip(rows.columns, names))
    known = [by_name[c] for c in identity]
    mark = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in known]
    numbered = _numbered(rows.toDF(*names), known, part_rows)
    parted = numbered.select(*names, F.xxhash64(F.lit(seed), *mark, "_copy").alias("_mark"))
    parted = parted.withColumn("_part", F.pmod("_mark", F.lit(n_parts)).cast("int"))
    found = {r["_part"]: r["count"] for r in parted.groupBy("_part").count().collect()}
    part_sizes = np.array([found.get(i, 0) for i in range(n_parts)], np.int64)
    sizes = cell_sizes(total, shards, cells)
    begins = np.cumsum(sizes) - sizes
    shard_begin = begins[::cells]
    schema = parted.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part_at, part_name = len(schema) - 1, schema[-1].name

    def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(values)) + 1
        yield from zip(np.append(0, edge), np.append(edge, len(values)))

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, place, ends = -1, 0, None, None
        for batch in source:
            values = batch.column(part_at).to_numpy()
            cell, order = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            for a, b in runs(values) if len(values) else ():
                if values[a] != part:
                    part, done = int(values[a]), 0
                    place = np.random.default_rng([seed, 1, part]).permutation(part_sizes[part])
                    ends = np.cumsum(matrix_row(part_sizes, sizes, part, seed))
                order[a:b] = place[done : done + b - a]
                cell[a:b] = np.searchsorted(ends, order[a:b], "right")
                done += b - a
            yield record_batch(
                pa.schema([*batch.schema, ("_cell", pa.int64()), ("_order", pa.int64())]), [*batch.columns, cell, order]
            )

    def settle(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, place = -1, 0, None
        for batch in source:
            values = batch.column(part_at + 1).to_numpy()
            shard, slot = np.zeros(len(values), np.int32), np.zeros(len(values), np.int64)
            for a, b in runs(values) if len(values) else ():
                if values[a] != at:
                    at, done = int(values[a]), 0
                    place = np.random.default_rng([seed, 2, at]).permutation(sizes[at])
                shard[a:b] = at // cells
                slot[a:b] = begins[at] - shard_begin[at // cells] + place[done : done + b - a]
                done += b - a
            plain_columns = batch.select(range(part_at - 1))
            yield record_batch(
                pa.schema([*plain_columns.schema, ("shard", pa.int32()), ("slot", pa.int64())]),
                [*plain_columns.columns, shard, slot],
            )

    dealt = (
        parted.repartition(part_name)
        .sortWithinPartitions(part_name, "_mark", *known)
        .mapInArrow(deal, f"{fields}, _cell long, _order long")
    )
    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return (
        dealt.repartition("_cell")
        .sortWithinPartitions("_cell", part_name, "_order")
        .mapInArrow(settle, f"{before}, shard int, slot long")
    )
