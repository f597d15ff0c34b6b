"""Registered queries of the training-data operators: thin digests over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    context_mixing, conversation_repair, decontamination, line_dedup, mixing, near_dedup, pii_surrogates, quality_classifier, quality_rules,
    secret_scans, simhash_dedup, url_filters, vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.anonymised(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(_table(spark, sf_dir, "pages"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.summary(_table(spark, sf_dir, "conversations"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_decontamination, op2_mixing, op3_pii_surrogates, op4_near_dedup, op5_quality_classifier, op6_line_dedup, op7_url_filters,
    op8_context_mixing, op9_quality_rules, op10_secret_scans, op11_conversation_repair, op12_simhash_dedup, op13_vector_codes)}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE, "op7_url_filters": url_filters.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE}
