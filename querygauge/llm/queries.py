"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from querygauge.llm import ann, chunk_dedup, language_id, license_scan, line_dedup, mixing, near_dup, packing, resampling, secret_scan, spelling, spotsigs, toxicity
from querygauge.llm.common import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@register
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", license_scan.license_scan(F.col("text")).alias("s")).select("doc_id", "s.*")


@register
def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    made = spotsigs.edited_documents(read(spark, folder, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


@register
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], with_ids=False)


@register
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, folder, "documents"), words=2, percent=80)


@register
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity.score(docs, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_words(read(spark, folder, "documents")).drop("source")


@register
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text"))
    return line_dedup.line_dedup(pages, "text", F.col("host"), counts=("n_lines", "n_dropped"))


ORACLE_SQL["op7_line_dedup"] = line_dedup.PAGES_SQL


@register
def op8_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.deduplicated(read(spark, folder, "documents"))


@register
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language_id.train(docs.filter(remainder(F.col("doc_id"), 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    found = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), language_id.language(docs, F.col("text"), model).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


@register
def op10_graph_ann(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    graph, members = ann.index(rows)
    queries = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    return ann.search(graph, members, queries)


@register
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLE_SQL["op11_resampling"] = resampling.SQL


@register
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_scan(read(spark, folder, "documents"))


@register
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read(spark, folder, "documents"))


ORACLE_SQL["op13_spelling"] = spelling.SQL
