"""Benchmark decontamination with SimHash windows and multi-index Hamming search.

A text is its words (runs of letters, marks and digits, lower-cased) and a window its bag of
``shingle`` word shingles. A window as long as a benchmark item, in words, gets a 64-bit SimHash of
its weighted shingles. Item fingerprints are entered under every block value within the block's
share of the radius, so each item within the radius of a window meets it in at least one block
(pigeonhole); the distance is then checked in full, and the exact weighted Jaccard similarity of
the two bags decides.

Windows are fingerprinted only where they can succeed: a shingle table of the items marks places
in the texts, and a window needs enough marks for its similarity to be reached at all, so this
leaves out no match. Of windows of one size the best begins at a mark or ends the text. A text
shorter than an item is one window. Everything is DataFrame functions.

Null and empty texts hold nothing; items without words match nothing; an item with fewer words
than a shingle is a single shingle. Rows equal in id and text count once; a null id comes back
null; other columns aren't read (``clean`` passes them through). Of several windows that match one
item the most similar is returned, the first of equals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profitloom.llm.common import stored

#: Bytes of marks, fingerprints or matches up to which they are broadcast; beyond it they are joined.
BROADCAST_BYTES = 32 << 20
_LANES = (1 << 32) | 1
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Contamination:
    """Similarity is ``percent`` of the union; a radius of 20 of 64 bits finds all but a few
    in ten thousand windows at that similarity. A longer text has several such windows for an
    item; a text shorter than the item has one, and the fewer its shingles the more are lost."""

    shingle: int = 5
    percent: int = 80
    radius: int = 20
    blocks: int = 7


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by place."""
    n = F.size(words) - F.lit(size - 1)
    at = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.xxhash64(F.lit(size), *[F.element_at(words, (i + k).cast("int")) for k in range(size)]),
    )
    return F.when(n > 0, at).otherwise(F.array().cast("array<bigint>"))


def lane_sums(shingle: Column) -> list[Column]:
    """Sums over a window from which its SimHash is read: two bits of the shingles in each."""
    return [F.sum(F.shiftright(shingle, j).bitwiseAND(F.lit(_LANES))).alias(f"_s{j}") for j in range(32)]


def fingerprint(n: str) -> Column:
    """The SimHash from the lane sums of ``n`` shingles: the majority of each bit."""
    low = [f"if((_s{j} & {_LOW}L) * 2 > {n}, shiftleft(1L, {j}), 0L)" for j in range(32)]
    high = [f"if(shiftright(_s{j}, 32) * 2 > {n}, shiftleft(1L, {j + 32}), 0L)" for j in range(32)]
    return F.expr(" | ".join(low + high))


def block_layout(blocks: int) -> list[tuple[int, int]]:
    """Shift and width of each block of the 64 bits."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _block(print_: str, shift: int, width: int) -> str:
    return f"(shiftrightunsigned({print_}, {shift}) & {(1 << width) - 1}L)"


def block_values(print_: str, blocks: int) -> Column:
    """The value of each block with its number, as structs (b, v)."""
    values = [f"struct({i} as b, {_block(print_, s, w)} as v)" for i, (s, w) in enumerate(block_layout(blocks))]
    return F.expr(f"array({', '.join(values)})")


def block_neighbours(print_: str, blocks: int, radius: int) -> Column:
    """All values within each block's share of the radius, as structs (b, v)."""
    out = []
    for i, (s, w) in enumerate(block_layout(blocks)):
        flips = [sum(1 << x for x in c) for r in range(radius // blocks + 1) for c in combinations(range(w), r)]
        masks = ", ".join(f"{f}L" for f in flips)
        out.append(f"transform(array({masks}), f -> struct({i} as b, {_block(print_, s, w)} ^ f as v))")
    return F.expr(f"concat({', '.join(out)})")


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))

    def times(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    counted = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda total, x: total + F.least(times(a, x), times(b, x))
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _small(frame: DataFrame, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the frame is measured to be small."""
    return F.broadcast(frame) if frame.count() * row_bytes <= BROADCAST_BYTES else frame


def with_key(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.withColumn("__row_key", F.xxhash64(F.lit("row"), docs[key].cast("string"), F.lit("text"), docs[text]))


def matches(
    docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(),
    text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """Rows (``__row_key``, doc_id, item_id, start_word, n_words, hamming, n_common, n_union, similarity)
    of each document and item it holds."""
    items = benchmark.select(F.col(item_key).alias("_item"), words_of(F.col(item_text)).alias("_w"))
    items = items.where(F.size("_w") > 0).withColumn("_k", F.least(F.size("_w"), F.lit(rule.shingle)))
    pick = F.lit(None).cast("array<bigint>")
    for k in range(1, rule.shingle + 1):
        pick = F.when(F.col("_k") == k, shingles_of(F.col("_w"), k)).otherwise(pick)
    items = stored(
        docs.sparkSession,
        items.select("_item", "_k", F.size("_w").alias("_size"), pick.alias("_bag")).withColumn(
            "_row", F.xxhash64("_item", "_bag")
        ),
        "benchmark-items",
    )
    sizes = sorted(r["_k"] for r in items.select("_k").distinct().collect())
    frame = with_key(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text", "_id")
    found = [_matches(frame, items.where(F.col("_k") == k), k, rule) for k in sizes]
    if not found:
        found = [_matches(frame.limit(0), items, rule.shingle, rule)]
    every = reduce(DataFrame.union, found)
    best = F.max_by(
        F.struct("_start", "_size", "_far", "_common", "_union"),
        F.struct(F.col("_common") / F.col("_union"), -F.col("_start"), -F.col("_far")),
    )
    return every.groupBy("__row_key", "_id", "_item").agg(best.alias("_best")).select(
        "__row_key",
        F.col("_id").alias(key),
        F.col("_item").alias(item_key),
        F.col("_best._start").cast("long").alias("start_word"),
        F.col("_best._size").cast("long").alias("n_words"),
        F.col("_best._far").cast("long").alias("hamming"),
        F.col("_best._common").cast("long").alias("n_common"),
        F.col("_best._union").cast("long").alias("n_union"),
        (F.col("_best._common") / F.col("_best._union")).alias("similarity"),
    )


def _matches(frame: DataFrame, items: DataFrame, k: int, rule: Contamination) -> DataFrame:
    """Matches with the items whose shingles have ``k`` words."""
    spark, p = frame.sparkSession, rule.percent
    words = frame.select("__row_key", "_id", words_of(F.col("_text")).alias("_w"))
    marks = _small(
        items.select(F.explode("_bag").alias("_h"), "_size").groupBy("_h").agg(F.collect_set("_size").alias("_sizes")), 64
    )
    placed = words.select("__row_key", F.posexplode(shingles_of(F.col("_w"), k)).alias("_at", "_h"))
    marked = (
        placed.join(marks, "_h")
        .select("__row_key", "_at", F.explode("_sizes").alias("_size"))
        .groupBy("__row_key", "_size")
        .agg(F.collect_set("_at").alias("_marks"))
        # The overlap is percent of the item's shingles at least, and each is a mark.
        .where(F.size("_marks") * 100 >= (F.col("_size") - (k - 1)) * p)
    )
    marked = stored(
        spark,
        marked.groupBy("__row_key").agg(F.collect_list(F.struct("_size", "_marks")).alias("_tries")),
        "marked-texts",
    )
    weight = marked.agg(F.sum(F.expr("aggregate(_tries, 64, (s, t) -> s + 24 + 4 * size(t._marks))"))).first()[0] or 0
    here = F.broadcast(marked) if weight <= BROADCAST_BYTES else marked
    held = (
        frame.join(here, "__row_key")
        .dropDuplicates(["__row_key"])
        .select("__row_key", "_id", "_tries", words_of(F.col("_text")).alias("_w"))
        .select("__row_key", "_id", "_tries", shingles_of(F.col("_w"), k).alias("_all"))
        .select("__row_key", "_id", "_all", F.explode("_tries").alias("_try"))
        .select("__row_key", "_id", "_all", "_try._size", "_try._marks")
        .withColumn("_full", F.col("_size") - (k - 1))
    )
    last = F.greatest(F.size("_all") - F.col("_full"), F.lit(0))
    starts = F.array_distinct(F.transform("_marks", lambda m: F.least(m, last)))
    length = F.least(F.col("_full"), F.size("_all"))
    seen = F.size(F.filter("_marks", lambda m: (m >= F.col("_start")) & (m < F.col("_start") + length)))
    windows = stored(
        spark,
        held.withColumn("_start", F.explode(starts))
        .where(seen * 100 >= (F.col("_full") + length - seen) * p)
        .select("__row_key", "_id", "_size", "_start", F.slice("_all", F.col("_start") + 1, length).alias("_bag")),
        "item-windows",
    )
    prints = (
        windows.select("__row_key", "_size", "_start", F.explode("_bag").alias("_h"))
        .groupBy("__row_key", "_size", "_start")
        .agg(F.count(F.lit(1)).alias("_n"), *lane_sums(F.col("_h")))
        .select("__row_key", "_size", "_start", fingerprint("_n").alias("_print"))
    )
    item_prints = (
        items.select("_row", "_size", F.explode("_bag").alias("_h"))
        .groupBy("_row", "_size")
        .agg(F.count(F.lit(1)).alias("_n"), *lane_sums(F.col("_h")))
        .select("_row", "_size", fingerprint("_n").alias("_other"))
    )
    # Copies of an item count its lanes twice over and keep their majority.
    index = stored(
        spark,
        item_prints.select(
            "*", F.explode(block_neighbours("_other", rule.blocks, rule.radius)).alias("_x")
        ).select("_row", "_size", "_other", "_x.b", "_x.v"),
        "item-prints",
    )
    near = (
        prints.select("*", F.explode(block_values("_print", rule.blocks)).alias("_x"))
        .select("__row_key", "_size", "_start", "_print", "_x.b", "_x.v")
        .join(_small(index, 48), ["_size", "b", "v"])
        .withColumn("_far", F.bit_count(F.col("_print").bitwiseXOR(F.col("_other"))))
        .where(F.col("_far") <= rule.radius)
        .select("__row_key", "_size", "_start", "_row", "_far")
        .distinct()
    )
    bags = items.select("_row", "_item", F.col("_bag").alias("_other_bag")).dropDuplicates(["_row"])
    common = bag_overlap(F.col("_bag"), F.col("_other_bag"))
    return (
        near.join(windows, ["__row_key", "_size", "_start"])
        .join(bags, "_row")
        .select("__row_key", "_id", "_item", "_start", "_size", "_far", common.alias("_common"),
                (F.size("_bag") + F.size("_other_bag")).alias("_sum"))
        .withColumn("_union", F.col("_sum") - F.col("_common"))
        .where(F.col("_common") * 100 >= F.col("_union") * p)
        .select("__row_key", "_id", "_item", "_start", "_size", "_far", "_common", "_union")
    )


def clean(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    hit = stored(docs.sparkSession, matches(docs, benchmark, rule, text, key).select("__row_key").distinct(), "contaminated")
    return with_key(docs, text, key).join(_small(hit, 16), "__row_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
