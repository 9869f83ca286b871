"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
writes each stage's result as Parquet to the shared folder and reads it again. All stages but the
last return the columns of ``documents``. Nulls, empty texts, copies, empty tables and further
columns are treated as the operators' modules say; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.llm import decontam, linededup, nearjoin, quality, wordpieces
from profitloom.llm.common import stored, table

#: Copies of lines in so many documents go.
LINE_DOCUMENTS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ``LINE_DOCUMENTS`` of them or more hold."""
    kept = linededup.dedup(docs, least=LINE_DOCUMENTS, report=False)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return nearjoin.keep_one(docs, nearjoin.JaccardRule())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return wordpieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Piece encoding can't be said in SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
