"""Order documents that can't be used, kept aside with their reasons.

Every landed line is parsed once and judged in the same pass: text that is no JSON or not of the
schema's types, an order without an id, a day or an amount that can't be read. Good pages and
rejected lines are written side by side, so that nothing is lost or silently null, and readers of
either don't parse again. Fields that the schema doesn't know don't reject a document; they are
counted, as a sign that the shop's format has moved on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from profitloom.functions.frames import grouped
from profitloom.functions.money import MONEY, quote
from profitloom.schemas import ORDER

_BROKEN = "_corrupt_record"
_PARSED = StructType([*ORDER]).add(_BROKEN, StringType())


def _unreadable(amount: str) -> str:
    return f"({amount} is not null and try_cast({amount} as {MONEY}) is null)"


# Why a document is rejected, in the order in which reasons are given.
PROBLEMS = {
    "not an order document": f"d.{_BROKEN} is not null or d is null",
    "no order id": f"d.{_BROKEN} is null and d.id is null",
    "no order day": f"d.{_BROKEN} is null and try_to_date(left(d.created_at, 10), 'yyyy-MM-dd') is null",
    "change time": f"d.{_BROKEN} is null and d.updated_at is not null and try_cast(d.updated_at as timestamp) is null",
    "amount": f"d.{_BROKEN} is null and ({_unreadable('d.total_discounts')} "
    f"or coalesce(exists(d.line_items, x -> {_unreadable('x.price')} or {_unreadable('x.total_discount')}), false) "
    f"or coalesce(exists(d.shipping_lines, x -> {_unreadable('x.price')}), false))",
}


def checked_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, value) with the document ``d``, ``problems`` and ``unknown_fields``; empty lines go."""
    parsed = lines.filter("trim(value) <> ''").select(
        "*",
        F.from_json("value", _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("d"),
    )
    reasons = ", ".join(f"if({when}, {quote(name)}, null)" for name, when in PROBLEMS.items())
    known = ", ".join(quote(name) for name in ORDER.names)
    return parsed.selectExpr(
        "*",
        f"array_compact(array({reasons})) as problems",
        f"coalesce(array_except(json_object_keys(value), array({known})), array()) as unknown_fields",
    )


@dataclass(frozen=True)
class Checked:
    """Where the result of a check lies."""

    spark: SparkSession
    path: str

    def _rows(self, good: bool) -> DataFrame:
        fields = "file string, value string, problems array<string>, unknown_fields array<string>"
        schema = StructType.fromDDL(fields).add("d", _PARSED).add("good", "boolean")
        return self.spark.read.schema(schema).parquet(self.path).filter(f"good = {str(good).lower()}")

    def orders(self) -> DataFrame:
        """The good pages, as ``read_orders`` gives them."""
        return self._rows(True).select(*[f"d.{name}" for name in ORDER.names])

    def rejected(self) -> DataFrame:
        """The rejected lines as they landed: file, value and problems."""
        return self._rows(False).select("file", "value", "problems")

    def counts(self) -> DataFrame:
        """(kind, name, documents): good and rejected documents, problems, and unknown fields."""
        kinds = (
            "concat(array(struct(if(good, 'good', 'rejected') as kind, '' as name)), "
            "transform(problems, p -> struct('problem' as kind, p as name)), "
            "transform(unknown_fields, f -> struct('unknown field' as kind, f as name)))"
        )
        both = self._rows(True).unionByName(self._rows(False))
        return grouped(both.selectExpr(f"inline({kinds})"), ["kind", "name"], "count(1) as documents")


def check_orders(spark: SparkSession, paths: str | list[str], target: str) -> Checked:
    """Parse and judge all documents below the paths once; good and rejected ones go to ``target``."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value")
    judged = checked_lines(lines).selectExpr("*", "size(problems) = 0 as good")
    # The text of a good document needn't be kept twice.
    kept = judged.selectExpr("file", "if(good, null, value) as value", "problems", "unknown_fields", "d", "good")
    kept.write.partitionBy("good").parquet(target)
    return Checked(spark, target)
