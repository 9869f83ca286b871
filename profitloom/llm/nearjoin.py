"""N-gram Jaccard self-join with signature trees.

A document is its set of word shingles; sets that are equal are one class. The top of the tree
splits classes by what linked sets must share: sets that reach the threshold differ in k tokens
at most, so if tokens are dealt by hash into more than k parts, some part is equal in both. Parts
go by size range, ranges overlap as far as sizes can link, and a part's token is a hash of its
content. Classes tied by equal parts, directly or through others, are a cluster; classes of
different clusters can't link. Shared passages and chance repeats should tie nothing, so there are
spare parts, and parts with too few rare shingles count only for sets that have more of them than
there are spare ones. What is rare comes from a table of counts over all documents whose size is
fixed; it decides how much is compared, never whether a link is found.

Chance ties grow with the square of the corpus, and passages that many texts share can tie texts that have
nothing else in common. So clusters too large for a block are dealt again, each by itself and by another
hash, with counts of their own texts, for as long as that splits them: sets that link stay together under
every dealing.

Below, a cluster is one block of classes, or several of bounded size split by set size and hash.
In each block, or pair of blocks, classes are the leaves of a tree whose nodes hold the OR of
their token bitmaps and their range of sizes. A dual traversal from the root drops pairs of nodes
whose largest possible overlap is too small, or that are in one component already, and compares
the leaves that are left exactly. Large clusters take two rounds, and block pairs that the first
round put in one component are left out of the second.

A null text, or one without words, has an empty set and links with nothing. A text with fewer
words than a shingle has its whole sequence as its one shingle. Rows with one id are one vertex;
rows without id take part with their text, and their component is the smallest id reached (null
if there is none). Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom.llm import ragged
from profitloom.llm.common import batches, record_batch, ship, stored
from profitloom.llm.components import components

_BYTES = 2 << 20
_U = np.uint64
#: Bits of a shingle's hash that pick its counter: 1 MB of counters whatever the corpus.
COUNTER_BITS = 18
_PIECE = 1 << 12
#: Bits of a digest that name a class between parts; classes that share them are one vertex there, which loses no link.
NODE_MASK = (1 << 40) - 1
#: Bytes of a token, besides its bucket, and of a node as they travel.
_TRAVEL = 5
#: How often large clusters are dealt again, and the share of their shingles that has to fall out for another time.
ROUNDS, WORTH = 4, 0.1
#: Parts' tokens that a task holds at a time, before and after the exchange.
PART_TOKENS = 1_000_000
#: Bytes of row numbers up to which clustered documents are found by broadcast.
BROADCAST_BYTES = 64 << 20
#: Shingles of a block.
BLOCK_SHINGLES = 2_000_000


@dataclass(frozen=True)
class JaccardRule:
    """Documents link when 100 * intersection >= ``percent`` * union of ``words``-word shingles."""

    words: int = 5
    percent: int = 80


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order of rows, and where each row's begin and end."""
    data, offsets = ragged.text_buffers(texts)
    n = len(offsets) - 1
    starts, ends, rows = ragged.words(data, offsets)
    word = ragged.hash_spans(ragged.LOWER[data], starts, ends)
    hashes, at = ragged.windows(word, rows, size)
    row = rows[at]
    total = ragged.counts(rows, n)
    short = np.flatnonzero((total > 0) & (total < size))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), _U)
        for k in range(size - 1):
            some = total[short] > k
            extra[some] = ragged.mix(extra[some] * _U(ragged.BASE_B) + word[first[some] + k] + _U(k + 1))
        hashes, row = np.concatenate((hashes, extra)), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    return hashes, np.searchsorted(row, np.arange(n + 1))


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text."""
    hashes, ends = shingle_hashes(texts, size)
    for a, b in zip(ends[:-1], ends[1:]):
        part = np.sort(hashes[a:b])
        yield part[np.concatenate(([True], part[1:] != part[:-1]))] if b > a else part


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set."""
    first = ragged.mix(tokens + _U(ragged.BASE_A)).sum()
    second = ragged.mix(tokens ^ _U(ragged.BASE_B)).sum()
    return int(first.view(np.int64)), int(second.view(np.int64))


def rare_cells(docs: DataFrame, rule: JaccardRule, text: str) -> np.ndarray:
    """For each cell of shingle hashes, whether the corpus fills it no more than chance would."""
    ship(docs.sparkSession)
    schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
    cells = 1 << COUNTER_BITS

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches(source, _BYTES):
            hashes, _ = shingle_hashes(batch.column(0), rule.words)
            total += np.bincount(cell_of(hashes), minlength=cells)
        pieces = np.flatnonzero(total.reshape(-1, _PIECE).any(axis=1))
        small = np.uint32 if total.max(initial=0) < 1 << 32 else np.int64
        parts = [total[p * _PIECE : (p + 1) * _PIECE].astype(small).tobytes() for p in pieces]
        yield record_batch(schema, [pieces.astype(np.int32), parts])

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in source:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint32 if len(raw) == 4 * _PIECE else np.int64).astype(np.int64)
                held[piece] = held[piece] + part if piece in held else part
        if held:
            yield record_batch(schema, [list(held), [v.tobytes() for v in held.values()]])

    kinds = "piece int, counts binary"
    pieces = docs.select(docs[text].alias("_text")).mapInArrow(count, kinds).repartition("piece").mapInArrow(add, kinds)
    out = np.zeros(cells, np.int64)
    for row in pieces.collect():  # 2 MB at most
        out[row["piece"] * _PIECE : (row["piece"] + 1) * _PIECE] = np.frombuffer(bytes(row["counts"]), np.int64)
    mean = out.mean()
    return out <= mean + 4 * np.sqrt(mean) + 4  # few counts spread wider than their root


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - COUNTER_BITS)).astype(np.int64)


def summaries(docs: DataFrame, rule: JaccardRule, text: str, key: str) -> DataFrame:
    """Set size and digest of each document, written to the shared folder."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            found = [(len(s), *(digest(s) if len(s) else (0, 0))) for s in sets(batch.column(1), rule.words)]
            schema = pa.schema([batch.schema.field(0), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
            yield record_batch(schema, [batch.column(0), *map(list, zip(*found))])

    frame = docs.select(docs[key].alias("_id"), docs[text].alias("_text"))
    kind = frame.schema[0].dataType.simpleString()
    return stored(docs.sparkSession, frame.mapInArrow(run, f"_id {kind}, n long, d1 long, d2 long"), "shingle-sets")


class Ranges:
    """Size ranges, and into how many parts the sets of a range are dealt.

    A range spans one step of the smallest linking ratio. Sets of range r are compared there with
    each other and with those sets of range r + 1 that are near enough in size. ``parts[r]``
    exceeds what such a pair can differ in by one and by ``spare[r]``, which makes up for parts
    with fewer than ``least[r]`` rare shingles: as many as a set of the range may have, if nine
    tenths of its shingles are rare.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.begin = [1]
        while self.begin[-1] <= largest:
            self.begin.append(100 * self.begin[-1] // percent + 1)
        self.parts, self.spare, self.least = [], [], []
        for first, after in zip(self.begin, self.begin[1:]):
            most = after - 1
            differ = (100 - percent) * (most + 100 * most // percent) // (100 + percent)
            least, spare = next(x for x in ((2, self._spare(first, differ, 2)), (1, self._spare(first, differ, 1)), (1, 2)) if x[1] is not None)
            self.parts.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)
            self.least.append(least)

    @staticmethod
    def _spare(first: int, differ: int, least: int) -> int | None:
        """Parts with fewer than ``least`` rare shingles that sets may have; None if too many."""
        spare = 0
        for _ in range(12):
            parts = differ + 1 + spare
            rate = 0.9 * first / parts
            mean = parts * np.exp(-rate) * (1 if least == 1 else 1 + rate)
            spare = int(np.ceil(mean + 3 * np.sqrt(mean)))
            if spare > 0.5 * (differ + 1) + 3:
                return None
        return spare

    def entries(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, ranges) under which sets of these sizes are entered: their own, and the one
        below if sets there are near enough."""
        begin = np.array(self.begin)
        own = np.searchsorted(begin, sizes, "right") - 1
        below = own - 1
        near = (own > 0) & (sizes > 0) & (self.percent * sizes <= 100 * (begin[own] - 1))
        parts = np.array(self.parts)
        out = []
        for rows, ranges in ((np.flatnonzero(sizes > 0), own), (np.flatnonzero(near), below)):
            rows = rows[parts[ranges[rows]] > 0]
            out.append((rows, ranges[rows]))
        return out


def part_tokens(
    flat: np.ndarray, sizes: np.ndarray, ranges: Ranges, rare: np.ndarray, dealing: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the parts of the sets that lie one after the other in ``flat``, and their rows."""
    spread = ragged.mix(flat ^ _U((0xC2B2AE3D27D4EB4F + dealing * ragged.BASE_A) & ((1 << 64) - 1)))
    seldom = rare[cell_of(flat)]
    begin = np.cumsum(sizes) - sizes
    tokens, owners = [], []
    low, high = spread & _U((1 << 26) - 1), (spread >> _U(26)) & _U((1 << 26) - 1)
    for rows, where in ranges.entries(sizes):
        if not len(rows):
            continue
        parts = np.array(ranges.parts)[where]
        at = np.repeat(begin[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
        first = np.cumsum(parts) - parts
        dealt = ((spread[at] >> _U(32)) * np.repeat(parts, sizes[rows]).astype(_U)) >> _U(32)
        place = np.repeat(first, sizes[rows]) + dealt.astype(np.int64)
        total = int(parts.sum())
        # Sums of 26-bit numbers are exact in doubles.
        one = np.bincount(place, low[at], total).astype(_U)
        two = np.bincount(place, high[at], total).astype(_U)
        strong = np.bincount(place, seldom[at], total) >= np.repeat(np.array(ranges.least)[where], parts)
        owner = np.repeat(rows, parts)
        weak = np.bincount(owner[~strong], minlength=len(sizes))
        many = np.zeros(len(sizes), bool)
        many[rows] = weak[rows] > np.array(ranges.spare)[where]
        part = np.arange(total) - np.repeat(first, parts)
        name = (np.repeat(where, parts).astype(_U) << _U(40)) | part.astype(_U)
        token = ragged.mix(ragged.mix(one * _U(ragged.BASE_A) + two) ^ ragged.mix(name + _U(1)))
        kept = strong | many[owner]
        tokens.append(token[kept])
        owners.append(owner[kept])
    if not tokens:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(owners)


def tie(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Tie nodes that share a token: each token once with the first of its nodes' components, and
    edges that span the components."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    same = np.flatnonzero((tokens[1:] == tokens[:-1]) & (nodes[1:] != nodes[:-1]))
    pairs = np.unique(np.stack((nodes[same], nodes[same + 1]), axis=1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    edges = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((x, y))
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    tokens, nodes = tokens[first], nodes[first]
    if root:
        seen, inverse = np.unique(nodes, return_inverse=True)
        nodes = np.array([find(x) for x in seen.tolist()], np.int64)[inverse]
    return tokens, nodes, edges


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def coarse_edges(
    docs: DataFrame, rows: DataFrame, rule: JaccardRule, text: str, dealing: int = 0, apart: str | None = None
) -> DataFrame:
    """Edges between the nodes (d1 & ``NODE_MASK``) of sets that have an equal part.

    Tokens travel as arrays, one for each bucket of tokens and about ``PART_TOKENS`` of them: a
    task ties what it holds first, and sends each token once. ``rows`` have the set sizes n. Only texts
    with one value of the whole number ``apart`` are tied, if it is given.
    """
    ship(docs.sparkSession)
    seen = rows.agg(F.max("n").alias("largest"), F.sum("n").alias("tokens")).first()
    ranges = Ranges(rule.percent, seen["largest"] or 1)
    rare = docs.sparkSession.sparkContext.broadcast(rare_cells(docs, rule, text))
    buckets = 1 << max(6, int(np.ceil(np.log2((seen["tokens"] or 1) / PART_TOKENS + 1))))
    shift = _U(64 - int(np.log2(buckets)))
    blob = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("nodes", pa.binary()), *_EDGE])

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            tokens, nodes, edges = tie(*(np.concatenate(x) for x in zip(*held)))
            cut = np.flatnonzero(np.diff((tokens >> shift).astype(np.int64))) + 1
            ends = np.concatenate(([0], cut, [len(tokens)]))
            out = []
            for a, b in zip(ends[:-1], ends[1:]):
                if b > a:
                    # Some bytes of a token besides its bucket are enough to tell a bucket's tokens apart.
                    rest = tokens[a:b] << (_U(64) - shift) >> _U(64 - 8 * _TRAVEL)
                    out.append((int(tokens[a] >> shift), _low(rest), _low(nodes[a:b].view(_U)), None, None))
            out += [(None, None, None, a, b) for a, b in edges]
            if out:
                yield record_batch(blob, [list(c) for c in zip(*out)])

        for batch in batches(source, _BYTES):
            found, groups = [], []
            for s, group in zip(sets(batch.column(0), rule.words), batch.column(1).to_pylist()):
                if len(s):
                    found.append(s)
                    groups.append(group)
            if not found:
                continue
            nodes = np.array([digest(s)[0] & NODE_MASK for s in found], np.int64)
            sizes = np.array([len(s) for s in found])
            tokens, owner = part_tokens(np.concatenate(found), sizes, ranges, rare.value, dealing)
            if apart:
                tokens = ragged.mix(tokens ^ ragged.mix(np.array(groups, np.int64).view(_U))[owner])
            held.append((tokens, nodes[owner]))
            count += len(tokens)
            if count >= PART_TOKENS:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        out = []
        for batch in source:
            for bucket, tokens, nodes, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket is None:
                    out.append((a, b))
                else:
                    held.setdefault(bucket, []).append((_wide(tokens), _wide(nodes).view(np.int64)))
        for arrays in held.values():
            out += tie(*(np.concatenate(x) for x in zip(*arrays)))[2]
        if out:
            yield record_batch(_EDGE, [list(c) for c in zip(*out)])

    groups = F.col(apart) if apart else F.lit(None).cast("long")
    dealt = docs.select(docs[text].alias("_text"), groups.alias("_apart")).mapInArrow(
        deal, "bucket long, tokens binary, nodes binary, a long, b long"
    )
    # Edges found before the exchange spread by their vertex.
    where = F.coalesce("bucket", F.col("a"))
    return dealt.repartition(buckets, where).mapInArrow(meet, "a long, b long")


def _low(values: np.ndarray) -> bytes:
    """The low bytes of each value, place by place: the highest of sorted values compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TRAVEL].T.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _TRAVEL, 8), np.uint8)
    out[:, :_TRAVEL] = np.frombuffer(raw, np.uint8).reshape(_TRAVEL, -1).T
    return out.view("<u8").ravel()


class Tree:
    """Classes as leaves, nodes with OR-combined bitmaps and size ranges, ``fan`` to a node."""

    def __init__(self, sets_: list[np.ndarray], percent: int, fan: int = 4):
        self.percent, self.fan = percent, fan
        self.sizes = np.array([len(s) for s in sets_], np.int64)
        width = 256
        while width < min(2 * self.sizes.max(), 1 << 15):
            width *= 2
        bits = np.zeros((len(sets_), width // 64), _U)
        flat = np.concatenate(sets_)
        row = np.repeat(np.arange(len(sets_)), self.sizes)
        place = flat & _U(width - 1)
        np.bitwise_or.at(bits, (row, (place >> _U(6)).astype(np.int64)), _U(1) << (place & _U(63)))
        # Tokens of a set beyond its bits, which the overlap of bitmaps doesn't see.
        slack = self.sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, self.sizes, self.sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), fan)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(slack, at),
                )
            )

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some leaves of nodes a and b could reach the threshold."""
        bits, low, high, slack = self.levels[level]
        p = self.percent
        out = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a])
        at = np.flatnonzero(out)
        step = max(1, (1 << 22) // bits.shape[1])
        for i in range(0, len(at), step):
            part = at[i : i + step]
            x, y = a[part], b[part]
            shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            most = np.minimum(shared + np.minimum(slack[x], slack[y]), np.minimum(high[x], high[y]))
            out[part] = (100 + p) * most >= p * (low[x] + low[y])
        return out


class Links:
    """Components of the classes of a group, from exact comparisons."""

    def __init__(self, sets_: list[np.ndarray], percent: int):
        self.sets, self.percent = sets_, percent
        self.root = list(range(len(sets_)))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(self, i: int, j: int) -> None:
        """Join the components of i and j if they link; nothing to do if they are one."""
        a, b = self.find(i), self.find(j)
        if a == b:
            return
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        if 100 * len(x) < self.percent * len(y):
            return
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int(np.count_nonzero(y[at] == x))
        if 100 * both >= self.percent * (len(x) + len(y) - both):
            self.root[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.root))], np.int64)


def link_group(sets_: list[np.ndarray], percent: int, orders: int = 4) -> list[tuple[int, int]]:
    """Edges that connect all classes of a group which are connected by links within it."""
    links = Links(sets_, percent)
    # Neighbours by a few min-hashes first: most of a group of copies is one component then.
    least = [
        np.array([ragged.mix(s ^ _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).min() for s in sets_])
        for k in range(orders if len(sets_) > 3 else 1)
    ]
    for mins in least[::-1]:
        order = np.argsort(mins, kind="stable")
        for i, j in zip(order[:-1].tolist(), order[1:].tolist()):
            links.compare(i, j)
    if len(sets_) > 2 and len(set(links.labels().tolist())) > 1:
        order = np.lexsort((least[0], [len(s) for s in sets_]))
        _traverse(links, order, Tree([sets_[i] for i in order], percent))
    return links.edges


def _traverse(links: Links, order: np.ndarray, tree: Tree) -> None:
    """Dual traversal: pairs of nodes from the root down to pairs of leaves."""
    fan, top = tree.fan, len(tree.levels) - 1
    label = links.labels()[order]
    low, high = [label], [label]
    for _ in range(top):
        at = np.arange(0, len(low[-1]), fan)
        low.append(np.minimum.reduceat(low[-1], at))
        high.append(np.maximum.reduceat(high[-1], at))

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        apart = ~((low[level][a] == high[level][a]) & (low[level][b] == high[level][b]) & (low[level][a] == low[level][b]))
        a, b = a[apart], b[apart]
        live = tree.may_link(level, a, b)
        a, b = a[live], b[live]
        if level == 0:
            for i, j in zip(order[a].tolist(), order[b].tolist()):
                links.compare(i, j)
            return
        n = len(low[level - 1])
        step = 1 << 14
        for k in range(0, len(a), step):
            x = (a[k : k + step, None, None] * fan + np.arange(fan)[None, :, None]) + np.zeros((1, 1, fan), np.int64)
            y = (b[k : k + step, None, None] * fan + np.arange(fan)[None, None, :]) + np.zeros((1, fan, 1), np.int64)
            x, y = x.ravel(), y.ravel()
            same = np.repeat(a[k : k + step] == b[k : k + step], fan * fan)
            fits = (x < n) & (y < n) & (~same | (x < y if level == 1 else x <= y))
            descend(level - 1, x[fits], y[fits])

    zero = np.zeros(1, np.int64)
    descend(top, zero, zero)


def _link_groups(rows: DataFrame, rule: JaccardRule) -> DataFrame:
    """Edges (a, b) between the nodes of rows (pair, node, tokens), group by group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, nodes, held = None, [], []
        a, b = [], []

        def finish():
            if len(nodes) > 1:
                for i, j in link_group(held, rule.percent):
                    a.append(nodes[i])
                    b.append(nodes[j])

        for batch in source:
            for p, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != pair:
                    finish()
                    pair, nodes, held = p, [], []
                nodes.append(node)
                held.append(np.frombuffer(raw, _U))
        finish()
        if a:
            yield record_batch(schema, [a, b])

    return rows.repartition("pair").sortWithinPartitions("pair", "node").select("pair", "node", "tokens").mapInArrow(run, "a long, b long")


def _represented(docs: DataFrame, members: DataFrame, text: str, key: str) -> DataFrame:
    """The texts (_text) of the rows that have the ids of the classes ``members``."""
    wanted = members.select(F.col("rep").alias("_id")).distinct()
    few = wanted.count() * 16 <= BROADCAST_BYTES
    rows = docs.select(docs[key].alias("_id"), docs[text].alias("_text"))
    return rows.join(F.broadcast(wanted) if few else wanted, rows["_id"].eqNullSafe(wanted["_id"]), "left_semi")


def _few(members: DataFrame) -> DataFrame:
    """Classes for a join, broadcast up to a bound."""
    return F.broadcast(members) if members.count() * 80 <= BROADCAST_BYTES else members


def contents(docs: DataFrame, members: DataFrame, rule: JaccardRule, text: str, key: str) -> DataFrame:
    """The whole shingle sets of the classes ``members`` (d1, d2, rep, ...), one row each."""
    rows = _represented(docs, members, text, key)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.binary())])
        for batch in batches(source, _BYTES):
            found = [s for s in sets(batch.column(0), rule.words) if len(s)]
            if found:
                first, second = zip(*(digest(s) for s in found))
                yield record_batch(schema, [list(first), list(second), [s.tobytes() for s in found]])

    whole = rows.select("_text").mapInArrow(run, "d1 long, d2 long, tokens binary")
    return whole.join(_few(members), ["d1", "d2"])


def split_large(
    docs: DataFrame, classes: DataFrame, clusters: DataFrame, rule: JaccardRule, text: str, key: str, block: int
) -> DataFrame:
    """Classes (d1, d2, n, rep, node) with their ``cluster``; those larger than a block are dealt again.

    A class that is tied to no other drops out. A large cluster of texts that do link stays as it is.
    """
    spark = docs.sparkSession
    named = clusters.select(F.col("v").alias("vertex"), F.col("root").alias("cluster"))
    members = stored(spark, _in_clusters(classes, named), "tied-classes")
    done, before, texts = None, None, None
    for dealing in range(1, ROUNDS + 1):
        weights = members.groupBy("cluster").agg(F.sum("n").alias("all"))
        large = weights.where(F.col("all") > block)
        total = large.agg(F.sum("all")).first()[0]
        if total is None or before is not None and total > (1 - WORTH) * before:
            break
        before = total
        small = members.join(large, "cluster", "left_anti")
        done = small if done is None else done.union(small)
        again = stored(spark, members.join(large.select("cluster"), "cluster", "left_semi"), "large-clusters")
        if texts is None:
            texts = stored(spark, _texts_of(docs, again, rule, text, key), "large-texts")
        named = _few(again.select("d1", "d2", "cluster"))
        edges = coarse_edges(texts.join(named, ["d1", "d2"]), again, rule, "_text", dealing, "cluster")
        named = components(edges).select(F.col("v").alias("vertex"), F.col("root").alias("part"))
        # A vertex may stand for classes of several clusters.
        parts = _in_clusters(again.withColumnRenamed("cluster", "old"), named.withColumnRenamed("part", "cluster"))
        members = stored(spark, parts.withColumn("cluster", F.xxhash64("old", "cluster", F.lit(dealing))).drop("old"), "tied-classes")
    return members if done is None else done.unionByName(members)


def _in_clusters(classes: DataFrame, named: DataFrame) -> DataFrame:
    """Classes with the ``cluster`` of their vertex; those without one drop out."""
    return classes.join(named, F.col("d1").bitwiseAND(F.lit(NODE_MASK)) == F.col("vertex")).drop("vertex")


def _texts_of(docs: DataFrame, members: DataFrame, rule: JaccardRule, text: str, key: str) -> DataFrame:
    """The texts (_text) of the classes, with their digests."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_text", pa.string()), ("d1", pa.int64()), ("d2", pa.int64())])
        for batch in batches(source, _BYTES):
            texts = batch.column(0)
            found = [digest(s) if len(s) else (0, 0) for s in sets(texts, rule.words)]
            yield record_batch(schema, [texts.cast(pa.string()), *map(list, zip(*found))])

    texts = _represented(docs, members, text, key).select("_text").mapInArrow(run, "_text string, d1 long, d2 long")
    return texts.join(_few(members.select("d1", "d2")), ["d1", "d2"], "left_semi")


def link_edges(docs: DataFrame, classes: DataFrame, clusters: DataFrame, rule: JaccardRule, text: str, key: str, block: int) -> DataFrame:
    """Edges between nodes whose sets link, enough to connect each component."""
    spark = docs.sparkSession
    members = split_large(docs, classes, clusters, rule, text, key, block)
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(rule.percent / 100))).cast("int")
    members = members.withColumn("band", band)
    weights = members.groupBy("cluster", "band").agg(F.sum("n").alias("w"))
    whole = weights.groupBy("cluster").agg(F.sum("w").alias("all"))
    weights = weights.join(whole, "cluster").withColumn("big", F.col("all") > block)
    weights = weights.select("cluster", "band", "big", F.ceil(F.col("w") / block).alias("parts"))
    # Classes of a large cluster are blocks by size band and hash; a small cluster is one block.
    members = members.join(weights, ["cluster", "band"]).select(
        "d1", "d2", "rep", "node", "n", "cluster",
        F.when(F.col("big"), F.col("band")).alias("band"),
        F.when(F.col("big"), F.pmod(F.xxhash64("d1", "d2"), F.col("parts"))).alias("part"),
    )
    members = stored(spark, members, "cluster-members")
    small, large = members.where("band is null"), members.where("band is not null")
    alone = contents(docs, small, rule, text, key).select(F.col("cluster").alias("pair"), "node", "tokens")
    edges = _link_groups(alone, rule)
    here = F.xxhash64("cluster", "band", "part")
    blocks = stored(spark, large.select("cluster", "band", "part").distinct().withColumn("block", here), "blocks")
    if blocks.isEmpty():
        return edges
    large = stored(spark, contents(docs, large, rule, text, key).withColumn("block", here), "cluster-sets")
    one, two = blocks.alias("x"), blocks.alias("y")
    pairs = one.join(two, F.expr("x.cluster = y.cluster and x.band <= y.band and y.band <= x.band + 1 "
                                 "and (x.band < y.band or x.part < y.part)"))
    pairs = pairs.select(F.col("x.block").alias("left"), F.col("y.block").alias("right"),
                         F.expr("x.band = y.band and y.part = x.part + 1 or x.band < y.band and x.part = 0 and y.part = 0").alias("near"))

    def linked(chosen: DataFrame) -> DataFrame:
        sides = chosen.select(F.xxhash64("left", "right").alias("pair"), F.explode(F.array("left", "right")).alias("block"))
        return _link_groups(large.join(sides, "block").select("pair", "node", "tokens"), rule)

    own = _link_groups(large.select(F.col("block").alias("pair"), "node", "tokens"), rule)
    first = stored(spark, own.union(linked(pairs.where("near"))), "block-links")
    roots = components(first)
    state = large.select("block", F.col("node").alias("v")).join(roots, "v", "left").groupBy("block")
    state = state.agg(F.min(F.coalesce("root", "v")).alias("low"), F.max(F.coalesce("root", "v")).alias("high"))
    state = stored(spark, state, "block-states")
    left, right = state.toDF("left", "low", "high"), state.toDF("right", "low2", "high2")
    rest = pairs.where("not near").join(left, "left").join(right, "right").where("low != low2 or high != high2 or low != high")
    return edges.union(first).union(linked(stored(spark, rest.select("left", "right"), "block-pairs")))


def _roots(docs: DataFrame, rule: JaccardRule, text: str, key: str, block: int) -> DataFrame:
    """_id, set size n and root of every document: the smallest id its links reach, a number beyond
    all ids (from 1 << 62) for a component without ids, null for an empty set."""
    spark = docs.sparkSession
    ship(spark)
    rows = summaries(docs, rule, text, key)
    classes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # A class of rows without id gets a node beyond all ids.
    node = F.coalesce(F.col("rep").cast("long"), F.shiftrightunsigned("d1", 1).bitwiseOR(F.lit(1 << 62)))
    classes = stored(spark, classes.withColumn("node", node), "classes")
    clusters = components(coarse_edges(docs, rows, rule, text))
    edges = link_edges(docs, classes, clusters, rule, text, key, block)
    # Rows with one id are one vertex, whatever their texts.
    some = rows.where("n > 0 and _id is not null")
    twice = some.groupBy("_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low != high").select("_id")
    if not twice.isEmpty():
        same = some.join(twice, "_id", "left_semi").join(classes, ["d1", "d2", "n"])
        edges = edges.union(same.select(F.col("_id").cast("long").alias("a"), F.col("node").alias("b")))
    roots = components(edges)
    known = classes.join(roots.withColumnRenamed("v", "node"), "node", "left")
    known = known.select("d1", "d2", "n", F.coalesce("root", "node").alias("root"))
    return rows.select("_id", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left").select("_id", "n", "root")


def join(docs: DataFrame, rule: JaccardRule = JaccardRule(), text: str = "text", key: str = "doc_id", block: int = BLOCK_SHINGLES) -> DataFrame:
    """``key``, n_shingles and component_id (smallest id that links reach) of every document."""
    found = _roots(docs, rule, text, key, block)
    component = F.when(F.col("n") == 0, F.col("_id").cast("long")).when(F.col("root") < (1 << 62), F.col("root"))
    return found.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, rule: JaccardRule = JaccardRule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, whole, of which each component keeps one row, of those with the smallest id.

    Rows without an id come after all ids, and are told apart by a hash of the text of 62 bits. Of several rows
    with the smallest id the one with the smallest hash of all its columns stays. Rows without shingles stay.
    """
    spark = docs.sparkSession
    by_text = F.shiftrightunsigned(F.xxhash64(docs[text]), 1).bitwiseOR(F.lit(1 << 62))
    vertex = F.coalesce(docs[key].cast("long"), by_text).alias("_vertex")
    found = _roots(docs.select(vertex, docs[text].alias("_text")), rule, "_text", "_vertex", BLOCK_SHINGLES).where("n > 0")
    later = stored(spark, found.where("_id != root").select(F.col("_id").alias("_later")).distinct(), "later-copies")
    twice = found.where("_id = root").groupBy(F.col("_id").alias("_twice")).agg(F.count(F.lit(1)).alias("copies"))
    twice = stored(spark, twice.where("copies > 1").select("_twice"), "repeated-ids")
    has_words = F.coalesce(docs[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words")
    rows = docs.select(F.struct("*").alias("_row"), vertex, has_words)

    def listed(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids

    kept = rows.join(listed(later), F.expr("_words and _vertex = _later"), "left_anti")
    if not twice.isEmpty():
        ids, same = listed(twice), F.expr("_words and _vertex = _twice")
        # Each task keeps one row per id before rows are exchanged.
        one = kept.join(ids, same, "left_semi").groupBy("_vertex").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        kept = kept.join(ids, same, "left_anti").select("_row").union(one.select("_row"))
    return kept.select("_row.*")
