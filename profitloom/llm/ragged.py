"""Texts of an Arrow batch as flat numpy arrays: bytes, lines, words, shingles and their hashes.

A text column becomes one byte array with row offsets; lines and words are spans in it. Nothing
here makes a Python string, so a task's work is a few passes over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: White space that parts words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD1342543DE82EF95
_CHUNK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` that stay in one row."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words."""
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines parted by a line feed; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    ends = np.concatenate((breaks, offsets[1:]))
    row = np.concatenate((np.arange(n), rows))
    first = np.argsort(row, kind="stable")  # a row's first start, then those after its breaks
    last = np.argsort(np.concatenate((rows, np.arange(n))), kind="stable")
    return starts[first], ends[last], row[first]


def strip(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each span without the bytes outside ``inside`` at its two ends; may be empty."""
    at = np.flatnonzero(inside)
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    some = high > low
    left, right = starts.copy(), starts.copy()
    left[some] = at[low[some]]
    right[some] = at[high[some] - 1] + 1
    return left, right


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < size:
        size = max(size, _CHUNK)
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        held = np.cumprod(up), np.cumprod(down)
        if size <= 4 * _CHUNK:
            _powers[base] = held
    return held


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and don't overlap.

    A polynomial over the bytes, taken from running sums, so that the cost is a pass over the
    bytes. Works through ``_CHUNK`` bytes at a time.
    """
    out = np.zeros(len(starts), _U)
    a = 0
    while a < len(starts):
        origin = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, origin + _CHUNK, "right")))
        part = data[origin : max(ends[b - 1], origin)]
        up, down = _power(base, len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=total[1:])
        s, e = starts[a:b] - origin, ends[a:b] - origin
        out[a:b] = mix((total[e] - total[s]) * down[s] + _U(0x9E37) * (e - s).astype(_U))
        a = b
    return out


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of ``size`` words that lies in one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total = np.zeros(len(at), _U)
    for k in range(size):
        total = total * _U(0xA0761D6478BD642F) + hashes[at + k]
    return mix(total), at


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many spans each row has, or the sum of their weights."""
    return np.bincount(rows, weights, minlength=n).astype(np.int64)
