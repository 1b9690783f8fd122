"""The registered queries of the training-data operators: one `opN_<name>` each, over whole tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, jaccard_join, langid, line_dedup, merkle, packing, quality_rules, range_join, repeats, secret_scan, topk_search, unit_dedup
from .common import table

#: Vocabulary files are parameters; these are the ones the registered queries use.
RANKS, WORDS, PIECES = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_scan.report(docs, secret_scan.model(spark, docs))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that don't depend on trained models."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", secret_scan.base_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    return secret_scan.summary(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(RANKS), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(WORDS).decode())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return quality_rules.report(docs, [quality_rules.Vocabulary("piece", vocabulary(PIECES)), quality_rules.Vocabulary("byte", vocabulary(RANKS), public_tokenizers.PATTERN)])


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11 that don't depend on a vocabulary."""
    counted = quality_rules.measure(table(spark, sf_dir, "documents", "doc_id", "text"), [])
    return counted.drop("text", "script").withColumn("base_failed", quality_rules.base_failed())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"secret_base_spans": secret_base_spans, "quality_base_counts": quality_base_counts}
