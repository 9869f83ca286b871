"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct new segments of a batch (spaces with the letters, or with the signs, that follow;
no piece crosses from one into the next) are joined into one text. Its suffixes are sorted, every piece of the vocabulary finds
its range of occurrences by binary search, and the occurrences are the edges of a lattice over
the text. Edges are sorted by where they end and relaxed in that order, all segments in step: an
edge holds if its piece and the piece before it stay apart when the library merges the two. The
encoding of every prefix is unique, so just one edge into each place holds, and the last pieces
read backwards are the library's own result.

Null and empty texts have no pieces and decode to the empty text. A text that holds the letter
U+2581 decodes to spaces there, as in the library, so its round trip is false. Equal rows encode
alike; other columns aren't read. Segments' results are kept between a task's batches, ``_KEPT`` at
most, and checked pairs of pieces between tasks, ``_PAIRS`` at most, as arrays.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from profitloom.llm.common import batches, record_batch, ship

SPACE = "▁"
_BYTES = 1 << 20
_KEPT = 250_000
_PAIRS = 2_000_000
#: Suffixes in one index; places that at most ``_FEW`` segments have are relaxed edge by edge, ``_EDGES`` at a time.
_SUFFIXES = 1 << 20
_FEW = 24
_EDGES = 1 << 14
_UNKNOWN = -2
_START = -1
_loaded: dict[str, Pieces] = {}


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


class Pieces:
    """The pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = size
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.id_of = {names[i]: i for i in normal}
        self.rank = {names[i]: -model.get_score(i) for i in normal}
        raw = [b""] * size
        for i in normal:
            raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        # Pieces that the merges really reach, and how their outer symbols change on the way.
        self.name = {i: names[i] for i in normal}
        self.head: dict[int, list[tuple[str, float]]] = {}
        self.tail: dict[int, list[tuple[str, float]]] = {}
        self.uneven: set[int] = set()
        for i in normal:
            self._trace(i, names[i])
        reached = sorted(self.head)
        self.longest = max(len(names[i]) for i in reached)
        letters = sorted({c for i in reached for c in names[i]})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.code[self.code == 0] = 1
        self.single = np.zeros(len(letters) + 2, bool)
        for i in reached:
            if len(names[i]) == 1:
                self.single[self.code[ord(names[i])]] = True
        self.piece = np.array(reached, np.int64)
        self.piece_size = np.array([len(names[i]) for i in reached], np.int64)
        codes = np.zeros((len(reached), self.longest), np.uint16)
        for row, i in enumerate(reached):
            codes[row, : len(names[i])] = self.code[[ord(c) for c in names[i]]]
        self.low = self._key(codes)
        codes[np.arange(self.longest) >= self.piece_size[:, None]] = 0xFFFF
        self.high = self._key(codes)
        self.pair = np.zeros(1, np.int64) - 1
        self.pair_apart = np.zeros(1, bool)
        self.segments = self._segments([names[i].replace(SPACE, " ") for i in reached])
        self.reset()

    @staticmethod
    def _segments(names: list[str]) -> Callable[[str], list[str]]:
        """Splitter between letters and signs, or only at spaces if pieces mix the two."""
        signs = ""
        for _ in range(2):
            pattern = re.compile(rf" *[^\W\d_{signs}]+| *(?:[^\w ]|[\d_{signs}])+| +")
            mixed = [n for n in names if not pattern.fullmatch(n)]
            if not mixed:
                return pattern.findall
            signs = "".join(sorted({c for n in mixed for c in n if re.match(r"[^\W\d_]", c)}))
        return re.compile(" +[^ ]*|[^ ]+").findall

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ids_size = np.zeros(0, np.int64)
        self.ids_start = np.zeros(0, np.int64)

    def _key(self, codes: np.ndarray) -> np.ndarray:
        """Rows of codes as byte strings that sort alike."""
        return np.ascontiguousarray(codes.astype(">u2")).view(f"S{2 * self.longest}").ravel()

    def _merge(self, symbols: list[str]) -> Iterator[tuple[int, float]]:
        """Merge in place, best pair first and leftmost of equals; yields place and rank."""
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == np.inf:
                return
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            yield at, best

    def _trace(self, i: int, name: str) -> None:
        symbols, last, even = list(name), -np.inf, True
        head, tail = [(symbols[0], -np.inf)], [(symbols[-1], -np.inf)]
        for at, rank in self._merge(symbols):
            even &= rank > last
            last = rank
            if at == 0:
                head.append((symbols[0], rank))
            if at == len(symbols) - 1:
                tail.append((symbols[-1], rank))
        if len(symbols) == 1:
            self.head[i], self.tail[i] = head, tail
            if not even:
                self.uneven.add(i)

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the text of two pieces is encoded as these two pieces."""
        if a in self.uneven or b in self.uneven:
            symbols = list(self.name[a] + self.name[b])
            for _ in self._merge(symbols):
                pass
            return symbols == [self.name[a], self.name[b]]
        tail, head, i, j = self.tail[a], self.head[b], 0, 0
        while True:
            cross = self.rank.get(tail[i][0] + head[j][0], np.inf)
            left = tail[i + 1][1] if i + 1 < len(tail) else np.inf
            right = head[j + 1][1] if j + 1 < len(head) else np.inf
            if cross < left and cross <= right and cross < np.inf:
                return False
            if left == right == np.inf:
                return True
            i, j = (i + 1, j) if left <= right else (i, j + 1)

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of and piece of every occurrence of a piece in the text."""
        padded = np.concatenate((codes, np.zeros(self.longest, np.uint16))).astype(">u2")
        starts, pieces = [], []
        # A suffix is laid out with as many letters as the longest piece has, so the index is by block.
        for first in range(0, len(codes), _SUFFIXES):
            n = min(_SUFFIXES, len(codes) - first)
            keys = self._key(np.lib.stride_tricks.as_strided(padded[first:], (n, self.longest), (2, 2)))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            low = np.searchsorted(keys, self.low, "left")
            sizes = np.searchsorted(keys, self.high, "right") - low
            starts.append(ragged_take(order, low, sizes) + first)
            pieces.append(np.repeat(np.arange(len(self.piece)), sizes))
        return np.concatenate(starts), np.concatenate(pieces)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments and keep the results."""
        sizes = np.array([len(s) for s in segments], np.int64)
        points = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        # A zero after each segment: no piece holds it, so no occurrence crosses.
        codes = np.insert(self.code[points], begin + sizes, 0)
        begin = begin + np.arange(len(segments))
        origin = np.repeat(begin, sizes + 1)
        start, piece = self.occurrences(codes)
        end = start + self.piece_size[piece]
        piece = self.piece[piece]
        alone = np.flatnonzero((codes > 0) & ~self.single[codes])
        start, end = np.concatenate((start, alone)), np.concatenate((end, alone + 1))
        piece = np.concatenate((piece, np.full(len(alone), _UNKNOWN)))
        depth = end - origin[start]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        last = np.full(len(codes) + 1, _UNKNOWN, np.int64)
        back = np.zeros(len(codes) + 1, np.int64)
        last[begin] = _START
        fresh: dict[int, bool] = {}
        # Places that most segments have are relaxed for all of them at once, those of few long ones edge by edge.
        ranked = np.sort(sizes)[::-1]
        many = int(ranked[_FEW]) if len(ranked) > _FEW else 0
        cut = np.searchsorted(depth, np.arange(1, many + 2))
        for a, b in zip(cut[:-1], cut[1:]):
            before, here = last[start[a:b]], piece[a:b]
            held = (before < 0) | (here < 0)
            doubt = np.flatnonzero(~held)
            if len(doubt):
                pairs, inverse = np.unique(before[doubt] * self.size + here[doubt], return_inverse=True)
                held[doubt] = self._apart(pairs, fresh)[inverse]
            at = np.flatnonzero(held)
            last[end[a:b][at]] = here[at]
            back[end[a:b][at]] = start[a:b][at]
        for a in range(int(cut[-1]), len(start), _EDGES):
            self._relax(start[a : a + _EDGES], end[a : a + _EDGES], piece[a : a + _EDGES], last, back, fresh)
        self._keep(fresh)
        self._read_back(points, begin, sizes, last, back, segments)

    def _relax(self, start, end, piece, last, back, fresh: dict[int, bool]) -> None:
        """Relax edges one by one in their order, which is by place."""
        seen: dict[int, bool] = {}
        lasts, backs, pairs, size = memoryview(last), memoryview(back), memoryview(self.pair), self.size
        for a, b, here in zip(start.tolist(), end.tolist(), piece.tolist()):
            before = lasts[a]
            if before >= 0 and here >= 0:
                pair = before * size + here
                held = seen.get(pair)
                if held is None:
                    held = fresh.get(pair)
                    if held is None:
                        i = bisect_left(pairs, pair)
                        if i < len(pairs) and pairs[i] == pair:
                            held = bool(self.pair_apart[i])
                        else:
                            held = fresh[pair] = self._stay_apart(before, here)
                    seen[pair] = held
                if not held:
                    continue
            lasts[b] = here
            backs[b] = a

    def _apart(self, pairs: np.ndarray, fresh: dict[int, bool]) -> np.ndarray:
        """Whether the two pieces of each pair stay apart; pairs not seen before go to ``fresh``."""
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        out = self.pair_apart[at]
        for i in np.flatnonzero(self.pair[at] != pairs).tolist():
            pair = int(pairs[i])
            held = fresh.get(pair)
            if held is None:
                held = fresh[pair] = self._stay_apart(*divmod(pair, self.size))
            out[i] = held
        return out

    def _keep(self, fresh: dict[int, bool]) -> None:
        """Add checked pairs to the sorted arrays, or begin these anew when they are full."""
        if not fresh:
            return
        keys, values = np.array(list(fresh), np.int64), np.array(list(fresh.values()), bool)
        if len(self.pair) + len(keys) <= _PAIRS:
            keys, values = np.concatenate((self.pair, keys)), np.concatenate((self.pair_apart, values))
        order = np.argsort(keys, kind="stable")
        self.pair, self.pair_apart = keys[order], values[order]

    def _read_back(self, points, begin, sizes, last, back, segments) -> None:
        """Follow the last pieces from each segment's end; unknown letters become their bytes."""
        at = begin + sizes
        live = np.flatnonzero(sizes > 0)
        rows, marks = [], []
        while len(live) > _FEW:
            rows.append(live)
            marks.append(at[live])
            at[live] = back[at[live]]
            live = live[at[live] > begin[live]]
        backs = memoryview(back)
        for row in live.tolist():
            mark, first, ends = int(at[row]), int(begin[row]), array("q")
            while mark > first:
                ends.append(mark)
                mark = backs[mark]
            rows.append(np.full(len(ends), row))
            marks.append(np.array(ends, np.int64))
        if not rows:
            return
        rows, marks = np.concatenate(rows), np.concatenate(marks)
        order = np.lexsort((marks, rows))
        rows, marks = rows[order], marks[order]
        piece = last[marks]
        lone = np.flatnonzero(piece == _UNKNOWN)
        width = np.ones(len(piece), np.int64)
        if len(lone):
            spelled = [chr(points[m - 1 - r]).encode() for m, r in zip(marks[lone], rows[lone])]
            width[lone] = [len(s) for s in spelled]
        flat = np.repeat(piece, width)
        if len(lone):
            first = np.cumsum(width) - width
            place = ragged_take(np.arange(len(flat)), first[lone], width[lone])
            flat[place] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        size = np.bincount(rows, width, minlength=len(segments)).astype(np.int64)
        base = len(self.ids_size)
        self.ids_start = np.concatenate((self.ids_start, len(self.ids) + np.cumsum(size) - size))
        self.ids_size = np.concatenate((self.ids_size, size))
        self.ids = np.concatenate((self.ids, flat.astype(np.int32)))
        self.known.update(zip(segments, range(base, base + len(segments))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.known) > _KEPT:
            self.reset()
        found = [self.segments(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh: set[str] = set()
        for segments in found:
            fresh.update(set(segments).difference(self.known))
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        which = np.fromiter((k for segments in found for k in map(known, segments)), np.int64)
        size = self.ids_size[which]
        row = np.repeat(np.arange(len(texts)), [len(s) for s in found])
        return ragged_take(self.ids, self.ids_start[which], size), np.bincount(
            row, size, minlength=len(texts)
        ).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as bytes, also where these are no UTF-8."""
        width = self.raw_size[ids]
        flat = ragged_take(self.raw, self.raw_start[ids], width)
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(sizes)))]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            text = flat[a:b].tobytes().removeprefix(b" ")
            out.append(text)
        return out


def load(path: str) -> Pieces:
    """The model of a file, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the piece ids of the whole text, their number, and the check of decoding them again.

    ``decoded_sha256`` is the digest of the decoded text in UTF-8; ``round_trip`` tells whether
    that is the text itself.
    """
    ship(docs.sparkSession)
    frame = docs.select(docs[key], docs[text].alias("_text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches(source, _BYTES):
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            ids, sizes = pieces.encode(texts)
            decoded = pieces.decode(ids, sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            schema = pa.schema(
                [
                    batch.schema.field(0),
                    ("n_pieces", pa.int64()),
                    ("piece_ids", pa.list_(pa.int32())),
                    ("decoded_sha256", pa.string()),
                    ("round_trip", pa.bool_()),
                ]
            )
            yield record_batch(
                schema,
                [
                    batch.column(0),
                    sizes,
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    [hashlib.sha256(d).hexdigest() for d in decoded],
                    [d == t.encode() for d, t in zip(decoded, texts)],
                ],
            )
        pieces.reset()

    kind = frame.schema[0].dataType.simpleString()
    return frame.mapInArrow(
        run, f"`{key}` {kind}, n_pieces long, piece_ids array<int>, decoded_sha256 string, round_trip boolean"
    )
