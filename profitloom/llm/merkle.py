"""Merkle manifest of a dataset: a content-addressed tree with a proof for every row.

A leaf is the digest of a row's fields. The leaves of a group stand in the order of their key; every
``FAN`` neighbours, and the rest at the end, become the digest of their digests, level by level until
one is left, the group's root. The groups' roots, in the order of the groups, give the root of all in
the same way.

The manifest's store holds records from a digest to its children, so equal parts are one record.
Proofs come by descent from the root: a request names a leaf by its rank, whose digits to the base
``FAN`` tell the child to follow at each level; the children that aren't followed are the proof's
segment of that level. Requests with the same digits so far are one row, so a level costs as many rows
as it has nodes asked for. Segments are collected from the root down and reversed at the end.

Ranks come from a range partitioning by group, key, leaf and row number, so no task has a group
to itself, also when a third of all rows are alike. Each level is written to the shared folder.

A null field is written ``-``, so it differs from an empty one. Rows with a null group are a group, the
first; null keys come first; rows equal in group and key stand in the order of their leaves, equal rows in any.
An empty table has no root and no proofs. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.llm.common import stored

FAN = 8
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def written(value: Column) -> Column:
    """A field as its length in bytes and its text; ``-`` if it is null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return digest(F.concat(*map(written, fields)))


@dataclass(frozen=True)
class Manifest:
    """Ranked leaves (``_g`` group, ``_n`` leaves of the group, ``_i`` rank, ``_d`` digest, further columns),
    the groups' roots alike, the nodes of each level upwards with their ``_children``, and the root."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    root: str | None


def ranked(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``_i``, their place in the group ``_g`` from 0 on, and ``_n``, its number of rows.

    Sorted ranges are numbered one by one; the group's rows in earlier ranges come on top.
    """
    keys = ["_g", *order]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(
        spark,
        ranges.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")),
        "manifest-ranks",
    )
    parts = placed.groupBy("_g", "_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    parts = parts.selectExpr(
        "_g",
        "_part",
        "sum(_rows) over (partition by _g order by _part) - _rows - _from as _shift",
        "sum(_rows) over (partition by _g) as _n",
    )
    return placed.join(parts, ["_g", "_part"]).withColumn("_i", F.col("_row") + F.col("_shift")).drop(
        "_part", "_row", "_shift"
    )


def tree(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """The levels above ranked nodes: (_g, _n, _i, _d, _children) of each, the lowest first."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    levels, width = [], 1
    while width < most:
        # Groups that are down to one node are done.
        child = F.struct((F.col("_i") % FAN).alias("p"), "_d")
        runs = (
            nodes.where(F.col("_n") > width)
            .groupBy("_g", "_n", F.floor(F.col("_i") / FAN).alias("_i"))
            .agg(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["_d"]).alias("_children"))
        )
        nodes = stored(spark, runs.withColumn("_d", digest(F.array_join("_children", ""))), "manifest-level")
        levels.append(nodes)
        width *= FAN
    return levels


def roots_of(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last digest of each group, (_g, _n, _d)."""
    found, width = nodes.where("_n = 1").select("_g", "_n", "_d"), 1
    for level in levels:
        width *= FAN
        found = found.unionAll(level.where((F.col("_n") > width // FAN) & (F.col("_n") <= width)).select("_g", "_n", "_d"))
    return found


def build(rows: DataFrame, group: str, key: str, leaf: str, *keep: str) -> Manifest:
    """Manifest of rows with a ``leaf`` digest, grouped and ordered; ``keep`` stays with the leaves."""
    spark = rows.sparkSession
    # A mark before the text keeps a null group apart from an empty one, and first.
    coded = F.coalesce(F.concat(F.lit("="), rows[group].cast("string")), F.lit(""))
    leaves = stored(
        spark,
        rows.select(
            coded.alias("_g"), rows[key].alias("_key"), rows[leaf].alias("_d"), *[rows[c].alias(f"_c{i}") for i, c in enumerate(keep)],
            F.monotonically_increasing_id().alias("_nr"),
        ),
        "manifest-leaves",
    )
    leaves = ranked(spark, leaves, ["_key", "_d", "_nr"]).drop("_nr")
    levels = tree(spark, leaves.select("_g", "_n", "_i", "_d"))
    groups = stored(spark, roots_of(leaves, levels).select(F.col("_g").alias("_of"), F.col("_n").alias("_size"), "_d"), "manifest-roots")
    subroots = ranked(spark, groups.withColumn("_g", F.lit("")), ["_of"])
    tops = tree(spark, subroots.select("_g", "_n", "_i", "_d"))
    last = roots_of(subroots, tops).first()
    return Manifest(leaves, levels, subroots, tops, last["_d"] if last else None)


def _segment(children: Column, at: Column) -> Column:
    """What isn't followed, left and right of the child at a place."""
    return F.struct(
        F.array_join(F.slice(children, 1, at), "").alias("left"),
        F.array_join(F.slice(children, at + 2, F.lit(FAN)), "").alias("right"),
    )


def descend(levels: list[DataFrame], roots: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """From roots (_g, _n, _d, _path, further columns) to the lowest runs (_g, _i, _children, _path, _deep).

    ``_deep`` is false for the only leaf of a group, which is its own root. ``wanted`` (_g, _i) names
    the leaves asked for; without it all are.
    """
    others = [c for c in roots.columns if c not in ("_g", "_n", "_d", "_path")]
    front = roots.withColumn("_i", F.lit(0).cast("bigint"))
    runs = front.where("_n <= 1").select(
        "_g", "_i", F.array("_d").alias("_children"), "_path", F.lit(False).alias("_deep"), *others
    )
    here = front.where("_n < 0")
    for height in range(len(levels), 0, -1):
        here = here.unionByName(front.where((F.col("_n") > FAN ** (height - 1)) & (F.col("_n") <= FAN**height)))
        if wanted is not None:
            prefixes = wanted.select("_g", F.floor(F.col("_i") / FAN**height).alias("_i")).distinct()
            here = here.join(prefixes, ["_g", "_i"], "left_semi")
        records = levels[height - 1].select("_d", "_children").dropDuplicates(["_d"])
        met = here.join(records, "_d")
        if height == 1:
            return runs.unionByName(met.select("_g", "_i", "_children", "_path", F.lit(True).alias("_deep"), *others))
        followed = met.select("_g", "_n", "_i", "_path", "_children", *others, F.posexplode("_children").alias("_at", "_d"))
        here = followed.select(
            "_g", "_n", (F.col("_i") * FAN + F.col("_at")).alias("_i"), "_d",
            F.concat("_path", F.array(_segment(F.col("_children"), F.col("_at")))).alias("_path"), *others,
        )
    return runs


def _whole(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the segments of its proof, from the leaf upwards."""
    return F.aggregate(path, leaf, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of ``manifest.leaves`` (all, or those wanted) with ``_subroot`` and ``_proof``, the segments
    from the leaf up to the root."""
    spark = manifest.leaves.sparkSession
    start = spark.createDataFrame([(manifest.root,)], "_d string").where("_d is not null")
    n = F.lit(manifest.subroots.count()).cast("bigint")
    top = start.select(F.lit("").alias("_g"), n.alias("_n"), "_d", F.array().cast(_PATH).alias("_path"))
    ends = descend(manifest.tops, top).select("_i", "_children", "_path", "_deep", F.posexplode("_children").alias("_at", "_d"))
    with_last = F.concat("_path", F.array(_segment(F.col("_children"), F.col("_at"))))
    ends = ends.select(
        (F.col("_i") * FAN + F.col("_at")).alias("_i"), F.when(F.col("_deep"), with_last).otherwise(F.col("_path")).alias("_path")
    )
    roots = manifest.subroots.drop("_g", "_n").join(ends, "_i").select(
        F.col("_of").alias("_g"), F.col("_size").alias("_n"), "_d", "_path", F.col("_d").alias("_subroot")
    )
    asked = manifest.leaves if wanted is None else wanted
    runs = descend(manifest.levels, roots, None if wanted is None else wanted.select("_g", "_i"))
    # Requests that differ in their last digit alone travel together, ``FAN`` at most.
    fields = [c for c in asked.columns if c != "_g"]
    together = asked.groupBy("_g", F.floor(F.col("_i") / FAN).alias("_run")).agg(F.collect_list(F.struct(*fields)).alias("_asked"))
    met = runs.withColumnRenamed("_i", "_run").join(together, ["_g", "_run"])
    met = met.select("_g", "_subroot", "_children", "_deep", F.reverse("_path").alias("_above"), F.explode("_asked").alias("_one"))
    last = _segment(F.col("_children"), (F.col("_one._i") % FAN).cast("int"))
    proof = F.when(F.col("_deep"), F.concat(F.array(last), F.col("_above"))).otherwise(F.col("_above"))
    return met.select("_g", *[f"_one.{c}" for c in fields], "_subroot", proof.alias("_proof"))


def leaves_with_claims(docs: DataFrame, fields: tuple[str, ...], text: str, altered: Column) -> DataFrame:
    """(_group, _key, _leaf, _claim) of documents whose key is the first field: the digest of a row as it is,
    and as it would be with A-Z of its text lower-cased where ``altered`` holds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(altered, F.translate(docs[text], upper, upper.lower())).otherwise(docs[text])
    real = leaf_of(*[docs[c] for c in fields])
    other = leaf_of(*[lowered if c == text else docs[c] for c in fields])
    return docs.select(
        docs["lang"].alias("_group"), docs[fields[0]].alias("_key"), real.alias("_leaf"),
        F.when(altered, other).otherwise(real).alias("_claim"),
    )


def audit(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Every document's leaf, group root, root, proof and the root that its claimed content folds to.

    A third of the documents, by a checksum of their id, claim a text with A-Z lower-cased; a null id or text
    claims what it is.
    """
    altered = F.coalesce(F.crc32(docs[fields[0]].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = leaves_with_claims(docs, fields, "text", altered)
    manifest = build(rows, "_group", "_key", "_leaf", "_claim")
    found = proofs(manifest)
    folded = found.select(
        F.col("_key").alias(fields[0]),
        F.col("_d").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        digest(_whole(F.col("_proof"))).alias("proof_sha256"),
        fold(F.col("_c0"), F.col("_proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
