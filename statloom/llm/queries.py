"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql

#: Where the public tokenizer's file is; a parameter of the codec.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def in_fold(key: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the key as text has this remainder; null is read as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_columns(docs: DataFrame, path: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(docs, path, keep_ids=True).drop("text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), pieces_path())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as scan

    found = scan.with_spans(table(spark, sf_dir, "documents", "doc_id", "text"), scan.train(spark))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{scan.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(scan.joined(F.col("base")), 256).alias("base_sha256"), scan.joined(F.col("spans")).alias("spans"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_lm

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = ngram_lm.train(docs.where(~in_fold("doc_id", 7, 2)).select("text"))
    held_out, train_tokens = in_fold("doc_id", 7, 2).alias("held_out"), F.lit(model.stats["tokens"]).cast("long").alias("train_tokens")
    # rounded, as sums of logarithms depend on their order in the last digits
    scores = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return ngram_lm.score_documents(docs, model).select("doc_id", held_out, "n_tokens", "n_known", train_tokens, *scores)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~in_fold("doc_id", 3, 1))
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda key: key % 20 == 0)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import classes_of

    return classes_of(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing, shared

    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))
    sized = shared.saved(sized, shared.folder(spark, "mix-rows"))  # texts are read and counted once
    return mixing.mix(sized, None).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iso_media import media_columns

    return media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import linked

    return linked(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import drawn

    return drawn(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


def l3_secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_secret_scan that SQL can tell: the spans of the fixed patterns."""
    return op3_secret_scan(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_lm_score": op4_lm_score,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_vector_search": op6_vector_search,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_media_columns": op9_media_columns,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
    "l3_secret_base": l3_secret_base,
}
SQL: dict[str, str] = {
    "op4_lm_score": sql.OP4_SQL,
    "op7_minhash_dedup": sql.OP7_SQL,
    "op8_source_mix": sql.OP8_SQL,
    "op9_media_columns": sql.OP9_SQL,
    "op10_substring_dedup": sql.OP10_SQL,
    "op11_embedding_dedup": sql.OP11_SQL,
    "op12_importance_resampling": sql.OP12_SQL,
    "op13_source_divergence": sql.OP13_SQL,
    "l3_secret_base": sql.L3_SQL,
}
