"""The queries on the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.llm import (
    decontam,
    htmltext,
    lexical,
    linededup,
    merkle,
    nearjoin,
    quality,
    secretscan,
    shards,
    tokens,
    urlfilter,
    warc,
    wordpieces,
)
from profitloom.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_PIECES = "piece_bpe_32k.model"
N_SHARDS = 24
URL_RULES = urlfilter.UrlRules(
    allow=("com/", "www.example.com/en/"),
    block=("example.com/en/", "net/es/", "net/fr/"),
    blocked_words=("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam"),
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "hamming", "n_common", "n_union", "similarity")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(spark, archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_repeats", "longest_repeat")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = shards.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], N_SHARDS)
    return dealt.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.join(table(spark, sf_dir, "documents"), nearjoin.JaccardRule(words=4, percent=85))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("found")
    known = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secretscan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(secretscan.written(known).cast("binary"), 256).alias("base_sha256"),
        secretscan.written(spans).alias("spans"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_warc, op3_sentencepiece, op4_quality, op5_url_filter,
        op6_line_dedup, op7_token_counts, op8_sharding, op9_jaccard_join, op10_html_text, op11_secret_scan,
        op12_merkle_manifest, op13_ranked_search,
    )}
