"""Token counts of byte-level BPE by merging in numpy, all sequences of a batch in step.

Distinct pre-tokens of a batch are ragged rows of symbols. In every round each row finds its pair
of lowest rank and merges all its places at once, left to right; rows without a mergeable pair
leave. What is left of a row is its token count. Counts of pre-tokens are kept between batches,
up to ``_KEPT`` of them, so a common word is merged once a task.

Null and empty texts have no tokens. Special strings in a text count as one token each, as the
tokenizer file's defaults have it. Equal rows count alike; other columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from profitloom.llm.common import batches, record_batch, ship

_BYTES = 2 << 20
_KEPT = 1_000_000
_FAR = np.iinfo(np.int64).max
_loaded: dict[str, ByteBpe] = {}

#: The pre-token pattern of the byte-level vocabularies; fixed value. White space is Unicode's.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same for texts below U+0100 without the separators U+001C to U+001F, in the faster library.
NOT_LATIN = re.compile("[\x1c-\x1f\u0100-\U0010ffff]").search
LATIN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+"
    r"| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|\s+(?!\S)|\s+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find_any = regex.compile(PATTERN).findall
        self.find_latin = re.compile(LATIN).findall
        self.split = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.known: dict[str, int] = {}

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return self.find_any(text) if NOT_LATIN(text) else self.find_latin(text)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each byte string ends up with."""
        left = np.array([len(p) for p in pieces], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), left)
        while len(symbol) > 1:
            key = np.where(row[1:] == row[:-1], symbol[:-1] * self.size + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], _FAR)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            best = np.minimum.reduceat(np.append(rank, _FAR), first)
            count = np.diff(np.append(first, len(row)))
            hit = (rank != _FAR) & (rank == np.repeat(best, count)[:-1])
            if not hit.any():
                break
            # Of places that overlap (one symbol twice running) every other one merges.
            place = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(place) > 1))
            place = place[(np.arange(len(place)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbol[place] = self.merged[at[place]]
            left -= np.bincount(row[place], minlength=len(left))
            stay = np.repeat(best != _FAR, count)
            stay[place + 1] = False
            symbol, row = symbol[stay], row[stay]
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > _KEPT:
            self.known.clear()
        known, found, fresh = self.known, [], set()
        for text in texts:
            parts = self.split(text) if self.split else [text]
            pieces = [p for part in parts for p in self.find(part)] if len(parts) > 1 else self.find(text)
            fresh.update(set(pieces).difference(known))
            found.append((pieces, len(parts) - 1))
        if fresh:
            new = list(fresh)
            known.update(zip(new, self.merge([p.encode() for p in new]).tolist()))
        return [sum(map(known.__getitem__, pieces)) + extra for pieces, extra in found]


def load(path: str) -> ByteBpe:
    """The vocabulary of a file, read once a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document."""
    ship(docs.sparkSession)
    frame = docs.select(docs[key], docs[text].alias("_text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches(source, _BYTES):
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).cast(pa.int64())
            n = pa.array(bpe.count(texts.to_pylist()), pa.int64())
            schema = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            yield record_batch(schema, [batch.column(0), size, n, pc.greater(n, limit)])

    kind = frame.schema[0].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
