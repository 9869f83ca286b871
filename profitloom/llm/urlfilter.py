"""URL filters with a cascade of Bloom filters.

Every url of the corpus yields the keys it could be listed under. Level 1 of the cascade encodes
the listed keys; level 2 the keys of the corpus that level 1 takes for listed though they aren't;
level 3 the listed keys that level 2 takes for those; and so on until a level errs on no key. As
the levels are built over all keys of the corpus, the answer for each of them is exact, and the
urls are judged in one pass without a join. Only DataFrame functions are used.

A key is 128 bits of hash: a host and its parents are hashed label by label from the end, each
from the one before it, so a host of very many labels costs no more than its length. Keys are told
apart by these bits. Levels stand in the plan, ``LEVEL_BYTES`` at most: a corpus with more keys is cut
into slices by hash, each with a cascade of its own over its keys, and slices are judged in turn.

A null url, or one without ``://``, has an empty host and path and can be listed under no key; an
empty list lists nothing; equal rows are judged alike; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.llm.common import stored

_CHUNK = 32768
#: Bytes that a level may have if all keys of a slice were in it.
LEVEL_BYTES = 16 << 20
_BITS, _HASHES = 8, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def parents_of(host: Column, word: str) -> Column:
    """Structs (a, b, size, hit) of a host's parents, the shortest first and the host itself last: two
    hashes, characters, and whether a label has a part that ``word`` matches."""
    kind = "struct<a:bigint,b:bigint,size:int,hit:boolean>"
    none = F.array().cast(f"array<{kind}>")

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def longer(s: Column, label: Column) -> Column:
        last = s["last"]
        now = F.struct(
            F.xxhash64(F.lit(1), last["a"], label).alias("a"),
            F.xxhash64(F.lit(2), last["b"], label).alias("b"),
            (last["size"] + 1 + F.char_length(label)).alias("size"),
            (last["hit"] | label.rlike(word)).alias("hit"),
        )
        return bind(now, lambda n: F.struct(n.alias("last"), F.concat(s["all"], F.array(n)).alias("all")))

    def through(last: Column, piece: Column) -> Column:
        return F.aggregate(piece, F.struct(last.alias("last"), none.alias("all")), longer)

    def whole(labels: Column) -> Column:
        # In pieces as long as the root of their number, as every step copies what its piece has so far.
        size = F.ceil(F.sqrt(F.size(labels))).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(labels) - 1) / size).cast("int")),
            lambda c: F.slice(labels, c * size + 1, size),
        )
        first = F.struct(
            F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(-1).alias("size"), F.lit(False).alias("hit")
        )
        return F.aggregate(
            pieces,
            F.struct(first.alias("last"), F.array().cast(f"array<array<{kind}>>").alias("all")),
            lambda s, piece: bind(
                through(s["last"], piece),
                lambda r: F.struct(r["last"].alias("last"), F.concat(s["all"], F.array(r["all"])).alias("all")),
            ),
            lambda s: F.flatten(s["all"]),
        )

    return F.when(host == "", none).otherwise(bind(F.reverse(F.split(host, r"\.", -1)), whole))


def _key(tag: str, parent: Column, path: Column | str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(
        F.xxhash64(F.lit(tag), parent["a"], path).alias("a"), F.xxhash64(F.lit(tag), parent["b"], path).alias("b")
    )


def candidates(parents: Column, path: Column, lengths: list[int]) -> Column:
    """Structs (key, tag, size, path, listed) of all that a url could be listed under: allowed or blocked
    (a, b) by a parent with a beginning of the path, blocked (w) by a parent alone."""

    def of(tag: str, n: int) -> Column:
        start = F.substring(path, 1, n)
        every = F.transform(
            parents,
            lambda p: F.struct(
                _key(tag, p, start).alias("key"), F.lit(tag).alias("tag"), p["size"].alias("size"), F.lit(n).alias("path"),
                F.lit(False).alias("listed"),
            ),
        )
        return F.when(F.char_length(path) >= n, every).otherwise(F.slice(every, 1, 0))

    alone = F.transform(
        parents,
        lambda p: F.struct(
            _key("w", p, "").alias("key"), F.lit("w").alias("tag"), p["size"].alias("size"), F.lit(0).alias("path"),
            p["hit"].alias("listed"),
        ),
    )
    return F.concat(*[of(tag, n) for tag in "ab" for n in lengths], alone)


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter as bytes; bit ``p`` is bit ``p % 8`` of byte ``p // 8``."""

    data: bytes
    seeds: tuple[int, ...]

    def may_hold(self, key: Column) -> Column:
        bits = 8 * len(self.data)
        # The bytes stand in the plan once, however many seeds there are.
        held = F.lit(bytearray(self.data))

        def is_set(seed: Column) -> Column:
            at = F.pmod(F.xxhash64(seed, key), F.lit(bits))
            byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10)
            return F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1

        return F.forall(F.array(*map(F.lit, self.seeds)), is_set)


def build_bloom(keys: DataFrame, level: int, bits_per_key: int, hashes: int) -> Bloom | None:
    """Filter of a one-column frame of distinct keys; None if there are none."""
    n = keys.count()
    if n == 0:
        return None
    bits = math.ceil(n * bits_per_key / _CHUNK) * _CHUNK
    seeds = tuple(1000 * level + i for i in range(hashes))
    # 4096-byte pieces, bits / 32768 of them at most.
    key = F.col(keys.columns[0])
    places = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s), key), F.lit(bits)) for s in seeds])).alias("_p"))
    pieces = (
        places.groupBy(F.floor(F.col("_p") / _CHUNK).alias("_c"))
        .agg(F.bitmap_construct_agg(F.col("_p") % _CHUNK).alias("_b"))
        .collect()
    )
    data = bytearray(bits // 8)
    for row in pieces:
        data[row["_c"] * 4096 : row["_c"] * 4096 + len(row["_b"])] = row["_b"]
    return Bloom(bytes(data), seeds)


@dataclass(frozen=True)
class Cascade:
    """Filters level by level."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: the first level that knows nothing of it decides."""
        held = F.lit(bool(len(self.levels) % 2))
        for i in range(len(self.levels), 0, -1):
            held = F.when(~self.levels[i - 1].may_hold(key), F.lit(i % 2 == 0)).otherwise(held)
        return held


def build_cascade(
    spark: SparkSession, universe: DataFrame, listed: DataFrame, bits_per_key: int = _BITS, hashes: int = _HASHES
) -> Cascade:
    """Cascade for the listed keys among all keys; both one column ``_key`` of distinct keys."""
    both = universe.withColumn("_listed", F.lit(False)).unionByName(
        listed.join(universe, "_key", "left_semi").withColumn("_listed", F.lit(True))
    )
    kept = stored(spark, both.groupBy("_key").agg(F.max("_listed").alias("_listed")), "url-keys")
    return cascade_of(kept, bits_per_key, hashes)


def cascade_of(keys: DataFrame, bits_per_key: int = _BITS, hashes: int = _HASHES) -> Cascade:
    """Cascade for distinct keys ``_key``, of which those with ``_listed`` are listed."""
    encoded, other = keys.where("_listed").select("_key"), keys.where("not _listed").select("_key")
    levels: list[Bloom] = []
    while (bloom := build_bloom(encoded, len(levels) + 1, bits_per_key, hashes)) is not None:
        levels.append(bloom)
        encoded, other = other.where(bloom.may_hold(F.col("_key"))), encoded
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class UrlRules:
    """Rules as host and path beginning, e.g. ``com/``; listed words that make a host blocked."""

    allow: tuple[str, ...]
    block: tuple[str, ...]
    blocked_words: tuple[str, ...] = ()


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))


def _listed_keys(rows: DataFrame, rules: UrlRules) -> DataFrame:
    """Distinct keys of the corpus and of the rules, with whether they are listed."""
    spark = rows.sparkSession
    named = [(tag, r[: r.index("/")], r[r.index("/") :]) for tag, rs in (("a", rules.allow), ("b", rules.block)) for r in rs]
    found = rows.select(F.explode("_keys").alias("_x")).select(F.col("_x.key").alias("_key"), F.col("_x.listed").alias("_listed"))
    if named:
        table = spark.createDataFrame(named, "tag string, host string, path string")
        whole = table.select("tag", "path", F.element_at(parents_of(F.col("host"), _NO_WORD), -1).alias("p"))
        keys = [whole.where(F.col("tag") == t).select(_key(t, F.col("p"), F.col("path")).alias("_key")) for t in "ab"]
        found = found.unionByName(keys[0].union(keys[1]).withColumn("_listed", F.lit(True)))
    return found.groupBy("_key").agg(F.max("_listed").alias("_listed"))


_NO_WORD = r"(?!)"


def judge(pages: DataFrame, rules: UrlRules, url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, host, path, the longest fitting rule or null, and the verdict allow or block.

    Where no rule fits, a url is blocked if its host or a parent of it is on the block list: all
    hosts and parents in the corpus with a blocked word as a part of a label.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key), F.col(url).alias("_url"))
    rows = rows.select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    word = rf"(?s)\A(?:.*-)?(?:{'|'.join(rules.blocked_words)})(?:-.*)?\z" if rules.blocked_words else _NO_WORD
    lengths = sorted({len(r) - r.index("/") for r in (*rules.allow, *rules.block)})
    keyed = rows.select("*", parents_of(F.col("host"), word).alias("_parents"))
    keyed = keyed.select(key, "host", "path", candidates(F.col("_parents"), F.col("path"), lengths).alias("_keys"))
    keys = stored(spark, _listed_keys(keyed, rules), "url-keys")
    # No level of a slice can be larger than all its keys in one.
    slices = max(1, -(-keys.count() * _BITS // (8 * LEVEL_BYTES)))
    if slices == 1:
        cascade = cascade_of(keys)
        judged = keyed.select(key, "host", "path", F.filter("_keys", lambda k: cascade.holds(k["key"])).alias("_found"))
    else:
        judged = _judged_in_slices(keyed, keys, slices, key)

    def longest(tag: str) -> Column:
        fits = F.filter("_found", lambda k: k["tag"] == tag)
        return F.array_max(F.transform(fits, lambda k: F.struct((k["size"] + k["path"]).alias("n"), k["size"].alias("size"), k["path"].alias("path"))))

    judged = judged.select(
        key, "host", "path", longest("a").alias("_allow"), longest("b").alias("_block"),
        F.exists("_found", lambda k: k["tag"] == "w").alias("_listed"),
    )
    blocked = F.col("_block").isNotNull() & (F.col("_allow").isNull() | (F.col("_block.n") > F.col("_allow.n")))
    best = F.when(blocked, F.col("_block")).otherwise(F.col("_allow"))
    rule = F.concat(F.right("host", best["size"]), F.expr("path").substr(F.lit(1), best["path"]))
    verdict = F.when(F.when(best.isNotNull(), blocked).otherwise(F.col("_listed")), "block").otherwise("allow")
    return judged.select(key, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _judged_in_slices(keyed: DataFrame, keys: DataFrame, slices: int, key: str) -> DataFrame:
    """Rows with the keys that are listed, slice by slice, so that one slice's levels are in a plan."""
    spark = keyed.sparkSession
    rows = stored(spark, keyed.select(F.monotonically_increasing_id().alias("_row"), key, "host", "path", "_keys"), "url-rows")
    asked = rows.select("_row", F.explode("_keys").alias("_x"))
    asked = stored(spark, asked.select("*", _slice(F.col("_x.key"), slices).alias("_slice")), "url-asked")
    sliced = stored(spark, keys.select("*", _slice(F.col("_key"), slices).alias("_slice")), "url-sliced")
    hits = []
    for k in range(slices):
        cascade = cascade_of(sliced.where(F.col("_slice") == k).select("_key", "_listed"))
        held = asked.where((F.col("_slice") == k) & cascade.holds(F.col("_x.key")))
        hits.append(stored(spark, held.select("_row", "_x"), "url-hits"))
    # A url is under one key a parent and length at most, so a group is no longer than its host has labels.
    found = reduce(DataFrame.union, hits).groupBy("_row").agg(F.collect_list("_x").alias("_found"))
    none = F.slice("_keys", 1, 0)
    return rows.join(found, "_row", "left").select(key, "host", "path", F.coalesce("_found", none).alias("_found"))
