"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import mixing, quality, shared
from statloom.llm.queries import op2_columns, pieces_path, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier doesn't reject; it learns from all labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    score = shared.unused(docs, "_score")
    return quality.score_documents(docs, model, name=score).where(f"{score} >= 0.5").drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, and each document without words."""
    from statloom.llm.minhash_dedup import deduplicated

    return deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret."""
    from statloom.llm.secret_scan import redacted

    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in the mix's order; documents it doesn't take go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each row, the ids of its text, and the digests of the encoding query; other columns end here."""
    return op2_columns(docs.select("doc_id", "text", "lang", "source"), pieces_path())


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None  # learned models and the codec are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for its own use is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = shared.folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before = len(shared.MADE)
        docs = shared.saved(stage(spark, docs, sf_dir), f"{at}/{k}")
        shared.remove_all(spark, before)
    return docs
