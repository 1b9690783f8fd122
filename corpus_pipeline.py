"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.llm import jaccard_join, langid, line_dedup, packing, secret_scan
from palmleaf.llm import queries as registered
from palmleaf.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected where its text has no letters, or where no language has the greater part of the probability over its windows.
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the network can tell; null texts and texts without letters go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(docs, model, "__lang", "__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete every later repeated run of lines and long line; documents of which only blanks are left after that go."""
    mended = line_dedup.dedup_lines(docs.select(*COLUMNS), "__gone")
    return _documents(mended.where((F.size("__gone") == 0) | F.col("text").rlike(r"\S")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates keep the document with the smallest id."""
    groups = jaccard_join.join(docs.select("doc_id", "text"))
    copies = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.scan(docs, secret_scan.model(spark, docs), "__spans")
    return _documents(secret_scan.redact(found, "__spans"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.pack(docs.select("doc_id", "text"), registered.vocabulary(registered.WORDS).decode())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: A trained network, word-shingle components and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage but the last is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
