"""Totals by key under change: counts of counts and largest keys from what a batch changed.

Orders come as signed rows, as they were and as they are. Totals per key are a log of such
differences in buckets by kind and hash, so a batch reads the buckets of its keys and no other, and
learns for each key its total before and after. From these two follow, at the cost of the keys that
changed:

* how many keys have each count: one off the old count, one on the new;
* the largest keys: every bucket keeps a bounded list of candidates and its floor, the rank of the best
  key that was left out. Keys off the list rank at the floor or below unless they changed, and then
  they were looked at. While the list holds a key above the floor, the largest is on it; when retractions
  have used it up, it is filled again from all totals of that bucket, exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profitloom.functions.frames import grouped
from profitloom.functions.money import cast
from profitloom.streaming.buckets import BucketLog

#: Candidates that a bucket keeps.
KEEP = 32
_RANK = "decimal(30,10)"
_BEST_FIRST = "partition by slot order by rank desc, key"


class KeyedTotals:
    """Totals of ``sums`` (name to type) by kind and text key, with the largest by each of ``ranks``,
    which name sums. Keys with ``live`` count; without orders a key is as if it never was.
    ``buckets`` is each kind's number of buckets, sized so that a bucket's keys suit a task."""

    def __init__(
        self, spark: SparkSession, path: str, sums: dict[str, str], ranks: list[str], buckets: list[int],
        live: str = "orders > 0", keep: int = KEEP,
    ):
        self.spark, self.path, self.sums, self.ranks, self.live, self.keep = spark, path, sums, ranks, live, keep
        first = ", ".join(f"{sum(buckets[:i])}L" for i in range(len(buckets)))
        self._slot = f"array({first})[kind] + pmod(xxhash64(key), array({', '.join(f'{b}L' for b in buckets)})[kind]) as slot"
        self._kind = f"cast(size(filter(array({first}), f -> f <= slot)) - 1 as bigint) as kind"
        schema = StructType().add("slot", "long").add("key", "string")
        for name, kind in sums.items():
            schema = schema.add(name, kind)
        self.log = BucketLog(spark, f"{path}/totals", schema)
        listed = StructType([*schema]).add("floor_rank", _RANK).add("floor_key", "string")
        self.tops = {rank: BucketLog(spark, f"{path}/top-{rank}", listed) for rank in ranks}

    def _summed(self, rows: DataFrame) -> DataFrame:
        return grouped(rows, ["slot", "key"], *[f"{cast(f'sum({c})', t)} as {c}" for c, t in self.sums.items()])

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's differences (kind, key and sums); rows without a key are left out.

        A batch that is run again writes the same, as it depends on earlier batches only.
        """
        slots = rows.filter("key is not null").selectExpr(self._slot, "key", *self.sums)
        touched = self.log.append(self._summed(slots), batch, "slot", 1)
        if not touched:
            return
        changed = self.log.of_batch(touched, batch).drop("batch")
        known = self.log.read(touched, batch - 1).drop("batch").join(changed.select("slot", "key"), ["slot", "key"], "left_semi")
        sides = known.selectExpr("*", "1 as was").unionByName(changed.selectExpr("*", "0 as was"))
        both = [f"{cast(f'sum({c})', kind)} as {c}" for c, kind in self.sums.items()]
        moved = grouped(sides, ["slot", "key"], *both, "coalesce(sum(orders) filter (where was = 1), 0L) as old_orders")
        # Sizes and the list of each rank are made of the same rows, so the old totals are looked up once.
        moved.write.mode("overwrite").parquet(f"{self.path}/moved")
        moved = self.spark.read.schema(moved.schema).parquet(f"{self.path}/moved")
        steps = self._kind, "inline(array(struct(old_orders as size, -1L as n), struct(orders as size, 1L as n)))"
        sizes = grouped(moved.selectExpr(*steps).filter("size > 0"), ["kind", "size"], "sum(n) as n").filter("n <> 0")
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/batch={batch}")
        for rank in self.ranks:
            self._follow(rank, moved.select("slot", "key", *self.sums), touched, batch)
        self.log.merge(touched, batch, self._summed, "slot", 1)

    def _listed(self, rows: DataFrame, rank: str, floors: DataFrame | None) -> DataFrame:
        """The best ``keep`` live keys of each slot above its floor, and the floor after that."""
        rows = rows.filter(self.live).selectExpr("slot", "key", *self.sums, f"cast({rank} as {_RANK}) as rank")
        if floors is None:
            rows = rows.selectExpr("*", f"cast(null as {_RANK}) as old_rank", "cast(null as string) as old_key")
        else:
            rows = rows.join(F.broadcast(floors), "slot", "left").filter(
                "old_rank is null or rank > old_rank or (rank = old_rank and key < old_key)"
            )
        placed = rows.selectExpr("*", f"row_number() over ({_BEST_FIRST}) as place").filter(f"place <= {self.keep + 1}")
        # The best of those that don't fit is the new floor.
        out = placed.filter(f"place = {self.keep + 1}").selectExpr("slot", "rank as out_rank", "key as out_key")
        return placed.filter(f"place <= {self.keep}").join(out, "slot", "left").selectExpr(
            "slot", "key", *self.sums, "coalesce(out_rank, old_rank) as floor_rank",
            "if(out_rank is null, old_key, out_key) as floor_key",
        )

    def _follow(self, rank: str, now: DataFrame, touched: list[int], batch: int) -> None:
        """Candidate lists of the touched buckets after a batch."""
        top = self.tops[rank]
        held = self._lists(top, touched, batch - 1)
        floors = held.filter("floor_rank is not null").selectExpr("slot", "floor_rank as old_rank", "floor_key as old_key").distinct()
        # Lists are short, whatever the batch: only the listed keys that changed meet them.
        listed = held.select("slot", "key", *self.sums)
        again = now.select("slot", "key").join(F.broadcast(listed.select("slot", "key")), ["slot", "key"], "left_semi")
        kept = listed.join(again, ["slot", "key"], "left_anti")
        lists = self._listed(kept.unionByName(now), rank, floors)
        lists.write.mode("overwrite").parquet(f"{self.path}/lists")
        lists = self.spark.read.schema(lists.schema).parquet(f"{self.path}/lists")
        # Just the buckets whose list is used up are filled again; their numbers are few.
        used_up = sorted(r["slot"] for r in floors.select("slot").join(lists.select("slot"), "slot", "left_anti").collect())
        if used_up:
            lists = lists.unionByName(self._listed(self._summed(self.log.read(used_up, batch)), rank, None))
        # A row without a key stands for every touched bucket, so that one without live keys has an empty list.
        marks = self.spark.range(1).selectExpr(f"explode(array({', '.join(f'{b}L' for b in touched)})) as slot")
        top.append(lists.unionByName(marks, allowMissingColumns=True), batch, "slot", 1)

    @staticmethod
    def _lists(top: BucketLog, buckets: list[int], upto: int) -> DataFrame:
        """The newest list of each bucket as of a batch."""
        found = {b: max((n for n in top.logged.get(b, ()) if n <= upto), default=None) for b in buckets}
        return top.open([(n, b) for b, n in found.items() if n is not None]).filter("key is not null").drop("batch")

    def largest(self, rank: str) -> DataFrame:
        """Per kind the key that ranks first over all buckets, the smallest of equals, with its sums."""
        top = self.tops[rank]
        rows = self._lists(top, sorted(top.logged), max((n for ns in top.logged.values() for n in ns), default=-1))
        best = F.expr(f"min(struct(-{rank} as neg, key, {', '.join(self.sums)})) as r")
        per_kind = rows.groupBy(F.expr(self._kind)).agg(best)
        return per_kind.selectExpr("kind", "r.key", *[f"r.{c}" for c in self.sums])

    def sizes(self) -> DataFrame:
        """Per kind how many keys have each number of orders: (kind, size, n)."""
        rows = self.spark.read.schema("kind bigint, size bigint, n bigint").parquet(f"{self.path}/sizes")
        return grouped(rows, ["kind", "size"], "sum(n) as n").filter("n <> 0")
