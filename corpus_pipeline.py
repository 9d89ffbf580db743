"""Corpus preparation in five stages; each works on all rows its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from querygauge.llm import language_id, line_dedup, mixing, near_dup, packing
from querygauge.llm.common import read, remainder, unused
from querygauge.session import scratch_path

LEAST_CERTAIN = 0.5  # a document whose language is less probable is rejected


def _same_columns(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` follows a changed text."""
    out = new.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else new
    return out.select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or of no certain language, go.

    Null and empty texts have no letter and go; rows with a null or repeated id, and rows that repeat, are each judged by their
    own text. An empty table stays empty. All given columns stay as they are, whatever their names."""
    model = language_id.train(docs.filter(remainder(F.col("doc_id"), 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    (name,) = unused(docs, "found_language")
    found = docs.withColumn(name, language_id.language(docs, F.col("text"), model))
    certain = (F.col(f"{name}.lang") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_CERTAIN)
    return found.filter(certain).select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on more than a tenth of their source's documents."""
    return _same_columns(docs, line_dedup.line_dedup(docs, "text", F.col("source")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id."""
    return near_dup.without_near_duplicates(docs, words=5, percent=80).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return _same_columns(docs, mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language scores, components, permutations and packing are not expressible in SQL; tests hold the operators, and the rows that near-dedup keeps, against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
