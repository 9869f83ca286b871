"""Secret scan: known shapes, and sliding-window Shannon entropy per character class.

Known shapes are three patterns: assignments to a telling name, access key ids, long hex strings.
Matches are leftmost and don't overlap within a kind; one that is too short is dropped after it was
matched, so it still uses up its characters.

The entropy scan looks at candidate strings, the maximal runs of a class's characters that are as
long as its window at least. A window slides over the run with one counter per symbol, six bits
each, packed into 64-bit lanes. A step takes one character out and one in, so the sum of
``n * log2(n)`` over the counts, which is all that the entropy depends on, changes by two differences
from a table. Sums are whole numbers (units of 2**-20 bits), so all orders of work give the same
result. A window is hot if its entropy reaches the class's bits and it has a digit and a character
that is none; overlapping and touching hot windows are one span. Spans on the allow-list go; the known
shapes always stay.

Everything is DataFrame functions without a shuffle. A run is worked through in blocks of ``BLOCK``
window places, places are summed up in pieces, so the work grows with the text, also where a
text is one unbroken run or holds very many matches.

A null or empty text has no spans; rows are scanned one by one, so repeated rows, null ids and
other columns don't matter; an empty table gives no rows. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window places that one scan over a run goes through.
BLOCK = 4096
#: Characters before a candidate that the allow-list sees.
BEFORE = 16
_BITS, _PER_LANE, _UNIT = 6, 10, 1 << 20

ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"(?<![0-9a-f])([0-9a-f]{32,})"


@dataclass(frozen=True)
class CharClass:
    """Symbols in order (as characters; several spellings of one symbol side by side), the window's
    length (63 at most) and the bits from which a window is hot."""

    kind: str
    pattern: str
    symbols: tuple[str, ...]
    window: int
    bits: float

    def limit(self) -> int:
        """Largest sum of ``n * log2(n)`` that a hot window may have."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * _UNIT)


_HEX_SYMBOLS = tuple("0123456789") + tuple(a + b for a, b in zip("abcdef", "ABCDEF"))
_BASE64_SYMBOLS = tuple("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_")
CLASSES = (
    CharClass("entropy16", "[0-9A-Fa-f]", _HEX_SYMBOLS, 32, 3.3),
    CharClass("entropy64", "[A-Za-z0-9+/_-]", _BASE64_SYMBOLS, 24, 4.0),
)


@dataclass(frozen=True)
class AllowList:
    """Patterns of harmless strings: of a whole run, inside a span, and right before a run."""

    whole: str = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    inside: str = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd]|0123456789|[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]"
    before: str = r"""([Ss][Hh][Aa](1|256|384|512)[:=-]|[Mm][Dd]5[:=-]|[Ii]ntegrity=["']?|[Bb]ase64,)$"""


@dataclass(frozen=True)
class SecretRules:
    """Least lengths of the known shapes, the classes of the entropy scan, the allow-list."""

    assigned: int = 8
    access: int = 16
    hexes: int = 32
    classes: tuple[CharClass, ...] = CLASSES
    allow: AllowList = AllowList()

    def kinds(self) -> list[str]:
        return ["assign", "access", "hex", *[c.kind for c in self.classes]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where it stands in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sum of an array up to each of its places, in pieces as long as the root of its length."""

    def within(piece: Column, start: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            piece,
            F.struct(start.alias("t"), none.alias("all")),
            lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["all"], F.array(s["t"] + x)).alias("all")),
            lambda s: s["all"],
        )

    def whole(piece: Column) -> Column:
        return F.aggregate(piece, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def joined(pieces: Column) -> Column:
        ends = within(F.transform(pieces, whole), F.lit(0).cast("bigint"))
        return let(
            F.struct(pieces.alias("p"), ends.alias("e")),
            lambda s: F.flatten(
                F.transform(s["p"], lambda p, i: within(p, F.when(i > 0, F.get(s["e"], i - 1)).otherwise(F.lit(0).cast("bigint"))))
            ),
        )

    def cut(a: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(a))).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / size).cast("int")),
            lambda c: F.slice(a, c * size + 1, size),
        )

    return let(values, lambda a: let(cut(a), joined))


def matches(text: Column, pattern: str) -> Column:
    """Structs (value, part, start, end, before) of all matches; ``part`` is the length of group 1."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("parts"),
        F.transform(
            F.split(text, pattern, -1),
            lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("tail")),
        ).alias("gaps"),
    )

    def placed(m: Column) -> Column:
        steps = F.transform(m["values"], lambda x, i: (F.get(m["gaps"], i)["n"] + F.char_length(x)).cast("bigint"))
        return let(
            F.struct(m.alias("m"), running_sums(steps).alias("ends")),
            lambda s: F.transform(
                s["m"]["values"],
                lambda x, i: F.struct(
                    x.alias("value"),
                    F.char_length(F.get(s["m"]["parts"], i)).alias("part"),
                    (F.get(s["ends"], i) - F.char_length(x)).alias("start"),
                    F.get(s["ends"], i).alias("end"),
                    F.get(s["m"]["gaps"], i)["tail"].alias("before"),
                ),
            ),
        )

    return let(found, placed)


def _table(values: dict[int, int]) -> Column:
    """A table by ASCII code."""
    return F.array(*[F.lit(values.get(code, 0)) for code in range(128)])


def hot_spans(run: Column, kind: CharClass) -> Column:
    """Structs (a, b) of the spans of hot windows in a run of the class's characters, from its start."""
    w = kind.window
    number = {ord(c): n for n, spellings in enumerate(kind.symbols) for c in spellings}
    lanes = -(-len(kind.symbols) // _PER_LANE)
    # Symbol and, as the lowest bit, whether it is a digit.
    codes = _table({c: 2 * n + chr(c).isdigit() for c, n in number.items()})
    size = F.array(*[F.lit(0 if n < 2 else round(n * math.log2(n) * _UNIT)).cast("bigint") for n in range(w + 2)])
    span = "array<struct<a:int,b:int>>"

    def count(held: Column, symbol: Column) -> Column:
        lane = F.get(held, F.floor(symbol / _PER_LANE).cast("int"))
        shift = (symbol % _PER_LANE) * _BITS
        return F.call_function("shiftright", lane, shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def changed(held: Column, symbol: Column, by: int) -> Column:
        step = F.call_function("shiftleft", F.lit(by).cast("bigint"), (symbol % _PER_LANE) * _BITS)
        at = F.floor(symbol / _PER_LANE).cast("int")
        return F.transform(held, lambda lane, j: F.when(j == at, lane + step).otherwise(lane))

    def scan(code: Column) -> Column:
        def taken_out(s: Column, i: Column) -> Column:
            """The counters without the character that the window leaves behind."""
            old = F.get(code, i - w)
            symbol = F.floor(old / 2).cast("int")
            n = count(s["held"], symbol)
            less = F.struct(
                changed(s["held"], symbol, -1).alias("held"),
                (s["sum"] - F.get(size, n) + F.get(size, n - 1)).alias("sum"),
                (s["digits"] - old % 2).alias("digits"),
            )
            return F.when(i >= w, less).otherwise(F.struct(s["held"], s["sum"], s["digits"]))

        def put_in(s: Column, less: Column, i: Column) -> Column:
            new = F.get(code, i)
            symbol = F.floor(new / 2).cast("int")
            n = count(less["held"], symbol)
            return F.struct(
                s["a"].alias("a"),
                s["b"].alias("b"),
                s["done"].alias("done"),
                changed(less["held"], symbol, 1).alias("held"),
                (less["sum"] - F.get(size, n) + F.get(size, n + 1)).alias("sum"),
                (less["digits"] + new % 2).alias("digits"),
            )

        def noted(t: Column, i: Column) -> Column:
            """The window that ends with character ``i`` opens a span or makes the open one longer."""
            hot = (i >= w - 1) & (t["sum"] <= kind.limit()) & (t["digits"] > 0) & (t["digits"] < w)
            apart = hot & (t["a"] >= 0) & (i - (w - 1) > t["b"])
            opened = hot & ((t["a"] < 0) | apart)
            closed = F.concat(t["done"], F.array(F.struct(t["a"].alias("a"), t["b"].alias("b"))))
            return F.struct(
                F.when(opened, i - (w - 1)).otherwise(t["a"]).alias("a"),
                F.when(hot, i + 1).otherwise(t["b"]).alias("b"),
                F.when(apart, closed).otherwise(t["done"]).alias("done"),
                t["held"].alias("held"),
                t["sum"].alias("sum"),
                t["digits"].alias("digits"),
            )

        zero = F.struct(
            F.lit(-1).alias("a"),
            F.lit(-1).alias("b"),
            F.array().cast(span).alias("done"),
            F.array(*[F.lit(0).cast("bigint")] * lanes).alias("held"),
            F.lit(0).cast("bigint").alias("sum"),
            F.lit(0).alias("digits"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(code) - 1),
            zero,
            lambda s, i: let(taken_out(s, i), lambda less: let(put_in(s, less, i), lambda t: noted(t, i))),
            lambda s: F.when(
                s["a"] >= 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))
            ).otherwise(s["done"]),
        )

    def block(raw: Column, k: Column) -> Column:
        part = F.substring(raw, k * BLOCK + 1, F.lit(BLOCK + w - 1)).cast("string")
        chars = F.transform(F.split(part, "", -1), lambda c: F.get(codes, F.ascii(c)))
        return F.transform(
            let(chars, scan), lambda s: F.struct((s["a"] + k * BLOCK).alias("a"), (s["b"] + k * BLOCK).alias("b"))
        )

    def merged(spans: Column) -> Column:
        """Spans of neighbouring blocks overlap where they go on; starts and ends both ascend."""
        first = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["b"] < s["a"]))
        last = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["a"] > s["b"]))
        return F.zip_with(first, last, lambda f, e: F.struct(f["a"].alias("a"), e["b"].alias("b")))

    blocks = F.sequence(F.lit(0), F.floor((F.octet_length(run) - w) / BLOCK).cast("int"))
    # Runs are ASCII, so bytes are characters, and a part of a binary value is found at once.
    every = let(run.cast("binary"), lambda raw: F.flatten(F.transform(blocks, lambda k: block(raw, k))))
    return let(every, merged)


def entropy_spans(text: Column, kind: CharClass, order: int, allow: AllowList) -> Column:
    """Spans of the class in a text, without what the allow-list names."""
    pattern = f"(?<!{kind.pattern})({kind.pattern}{{{kind.window},}})"

    def of_run(m: Column) -> Column:
        raw = m["value"].cast("binary")
        span = F.transform(
            hot_spans(m["value"], kind),
            lambda s: F.struct(
                (m["start"] + s["a"]).alias("start"),
                F.lit(order).alias("order"),
                (m["start"] + s["b"]).alias("end"),
                F.substring(raw, s["a"] + 1, s["b"] - s["a"]).cast("string").alias("value"),
            ),
        )
        return _bare(F.filter(span, lambda s: ~s["value"].rlike(allow.inside)))

    def allowed(m: Column) -> Column:
        return m["value"].rlike(allow.whole) | m["before"].rlike(allow.before)

    found = F.filter(matches(text, pattern), lambda m: ~allowed(m))
    return _if_any(text, pattern, F.flatten(F.transform(found, of_run)))


_SPANS = "array<struct<start:bigint,order:int,end:bigint>>"


def _bare(spans: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"))
    )


def _if_any(text: Column, pattern: str, spans: Column) -> Column:
    """Most texts hold no match, which one look tells."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def known_spans(text: Column, pattern: str, order: int, least: int) -> Column:
    """Spans of a known shape whose group has ``least`` characters or more."""
    found = F.filter(matches(text, pattern), lambda m: m["part"] >= least)
    spans = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"))
    )
    return _if_any(text, pattern, spans)


def scan(
    docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns of each document with ``found``: all spans (kind, start, end), by start,
    then in the order of the kinds."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    shapes = [(ASSIGN, rules.assigned), (ACCESS, rules.access), (HEX, rules.hexes)]
    kinds = rules.kinds()
    columns = [known_spans(whole, pattern, i, least).alias(f"_s{i}") for i, (pattern, least) in enumerate(shapes)]
    columns += [
        entropy_spans(whole, kind, len(shapes) + i, rules.allow).alias(f"_s{len(shapes) + i}")
        for i, kind in enumerate(rules.classes)
    ]
    frame = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    spans = frame.select(*[f"_k{i}" for i in range(len(keep))], *columns)
    every = F.array_sort(F.concat(*[f"_s{i}" for i in range(len(kinds))]))
    named = F.transform(
        every,
        lambda s: F.struct(
            F.get(F.array(*map(F.lit, kinds)), s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )
    return spans.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], named.alias("found"))


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")
