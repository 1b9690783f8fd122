"""Readers: paragraph documents, JSON trees and records, metadata indexes, chunk and vector tables, flag logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.sources import docx

_INDEX = "map<string,map<string,string>>"


def list_files(spark: SparkSession, folder: str, suffix: str, ignore_case: bool = False) -> DataFrame:
    """(path, name, modified, length) of the files of a folder that end in `suffix`; contents are not read."""
    pattern = "*" + ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix) if ignore_case else suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("modificationTime").alias("modified"), "length")


def read_docx(spark: SparkSession, folder: str, ignore_case: bool = False) -> DataFrame:
    """(doc_id, para_no, text, error): the paragraphs of a folder's DOCX files; doc_id is the file name without extension.

    A file that can't be read gives one row with `error` and no text, so others go on. Spark opens the files, in any store it
    knows; `spark.read.format("docx")`, once registered by `docx.register`, gives the same rows.
    """
    pattern = "*.[dD][oO][cC][xX]" if ignore_case else "*.docx"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select(F.regexp_replace(F.regexp_extract("path", "[^/]+$", 0), r"\.[^.]*$", "").alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, data in zip(pdf["doc_id"], pdf["content"], strict=True):
                yield pd.DataFrame(docx.paragraph_rows(doc, bytes(data)), columns=["doc_id", "para_no", "text", "error"])

    return named.mapInPandas(run, docx.SCHEMA)


def read_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, value): whole JSON files of a folder, for `parse_trees`."""
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return text.select(name.alias("source_file"), "value")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, metadata, noi_dung) of segment records, parsed with a fixed schema; other shapes have null fields."""
    parsed = F.from_json("value", "metadata map<string,string>, noi_dung array<string>")
    return read_json_files(spark, folder).withColumn("r", parsed).select("source_file", "r.metadata", "r.noi_dung")


def read_metadata_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, meta) of a metadata index, a JSON object of objects. A missing, unreadable or empty one is an error."""
    out = _index(spark, path)
    if out.isEmpty():
        raise ValueError(f"no metadata in {path}")
    return out


def read_metadata_cache(spark: SparkSession, path: str) -> DataFrame:
    """As `read_metadata_index`, but empty where the file is missing or can't be parsed."""
    try:
        out = _index(spark, path)
        out.isEmpty()
        return out
    except PySparkException:
        return spark.createDataFrame([], "name string, meta map<string,string>")


def _index(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", _INDEX)).alias("name", "meta"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of a chunk table that the sync needs."""
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("id"), "content", "metadata", "last_updated")


def read_vector_times(spark: SparkSession, path: str) -> DataFrame:
    """(id, last_updated) of a vector table; no other column is scanned. A table that isn't there is empty."""
    try:
        return spark.read.parquet(path).select("id", "last_updated")
    except PySparkException:
        return spark.createDataFrame([], "id string, last_updated timestamp")


def read_flags(spark: SparkSession, folder: str, pattern: str = "dataset*.csv") -> DataFrame | None:
    """The rows of the newest flag log of a folder, all columns as text; None where there is none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    except PySparkException:
        return None
    if newest is None:
        return None
    rows = spark.read.csv(newest, header=True, multiLine=True, escape='"', lineSep="\n")
    # lines may end either way, even within one file
    return rows.select(*[F.regexp_replace(F.col(f"`{c}`"), "\r$", "").alias(c.strip()) for c in rows.columns])
