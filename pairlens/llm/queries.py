"""Queries of this folder's operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convrepair, decontam, filteraudit, interpolation, langid, mixing, permindex, quality, simhash, tokencount, toxicity, vectordedup, warc
from .common import read, remainder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.search(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    r = remainder("doc_id", 7)
    out = interpolation.score_texts(docs, r != 2, r == 3)
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity.predict(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 3) != 1)
    return quality.predict(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(read(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_mixing, op3_simhash, op4_permutation_index, op5_deleted_interpolation, op6_toxicity, op7_decontamination, op8_warc, op9_token_counts, op10_quality, op11_filter_audit, op12_conversation_repair, op13_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express. The others need hashes, learned models, or alignments that it does not have; see tests/llm for the brute-force versions."""
    return {"op11_filter_audit": filteraudit.SQL, "op12_conversation_repair": convrepair.SQL}
