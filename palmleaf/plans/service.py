"""The library's surface: ingest, chunk, sync, search, answer, flag_report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palmleaf.config import Settings
from palmleaf.functions.text import known_name, nfc
from palmleaf.operators import answer as A
from palmleaf.operators import chunk as C
from palmleaf.operators import enrich, flatten, report, segment, sync
from palmleaf.operators.ledger import Ledger
from palmleaf.operators.search import nearest
from palmleaf.sources import readers, writers


def ingest(paragraphs: DataFrame, index: DataFrame, strategy: int = 2, names: dict[str, str] | None = None, literal_labels: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Segment records (file_name, metadata, noi_dung) of paragraph streams (doc_id, para_no, text), with book metadata. The settings
    say how long titles and names of files may be."""
    parts = segment.segments_v1(paragraphs, literal_labels) if strategy == 1 else segment.segments_v2(paragraphs)
    book = known_name(F.col("doc_id").cast("string"), names or {})
    named = parts.withColumn("__book", book if strategy == 1 else F.replace(book, F.lit("_"), F.lit(" ")))
    key = enrich.match_key_b if strategy == 1 else enrich.match_key_a
    full = enrich.with_metadata(named, "__book", index, key).drop("__book")
    return writers.segment_records_v1(full, settings) if strategy == 1 else writers.segment_records_v2(full, settings)


def vector_table(spark: SparkSession, settings: Settings) -> writers.VersionedTable:
    """The vector table that the settings name; without a name it is an error."""
    if not settings.vector_table:
        raise ValueError("settings without a value: vector_table")
    return writers.VersionedTable(spark, settings.vector_table)


def enrich_cache(rows: DataFrame, name_col: str, path: str, enrich_fn: Callable[[str], dict | None], ledger: Ledger, settings: Settings = Settings()) -> DataFrame:
    """The metadata cache under `path` with an entry for every name of `rows`: missing ones are asked for, each once and at no more than
    documents_per_minute, and the cache is written anew."""
    table = writers.VersionedTable(rows.sparkSession, path)
    cache = table.read()
    cache = cache if cache is not None else rows.sparkSession.createDataFrame([], "name string, meta map<string,string>")
    table.replace(enrich.enrich_once(rows, name_col, cache, enrich_fn, ledger, per_minute=settings.documents_per_minute))
    return table.read()


def chunk(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunk rows (id, content, metadata, source_file, doan_so, last_updated) of JSON files (source_file, value).

    Texts are brought to normal form C, trees flattened in pre-order, repeats within a file dropped, sentences packed.
    """
    nodes = flatten.flatten(files.select("source_file", nfc("value").alias("value")))
    parts = C.number_chunks(C.chunk_rows(flatten.first_occurrences(nodes), most=settings.chunk_chars))
    meta = enrich.overlay(F.col("metadata"), {"doan_so": F.col("doan_so")})
    return parts.select(flatten.chunk_id().alias("id"), "content", meta.alias("metadata"), "source_file", "doan_so", F.current_timestamp().alias("last_updated"))


#: Most ids of a sync by which the vector table is filtered before they are compared.
FEW_IDS = 1000


def sync_vectors(chunks: DataFrame, table: writers.VersionedTable, embed_fn: Callable, settings: Settings = Settings(), deletes: bool = False) -> DataFrame:
    """Embed what is new or newer, merge it into the table, and return the counts by action.

    Vectors: (id, embedding, document, metadata, last_updated). Only changed rows reach the model and are written; of the table
    ids and times are read, bucket by bucket, without being shuffled; where few ids come in, of their buckets only. Of rows that
    repeat an id the newest counts; null ids don't. What is to be done is worked out once and written beside the versions; of those the newest two
    stay, the one that readers may have open and its successor. A sync without changes writes nothing.
    """
    spark = chunks.sparkSession
    chunks = sync.newest(chunks)
    few = [r["id"] for r in chunks.select("id").limit(FEW_IDS + 1).collect()]
    # deletions need all ids of the table; otherwise those of the chunks are looked up in it
    old = table.read() if deletes else table.current(chunks, "last_updated", few=few if len(few) <= FEW_IDS else None)
    times = old.select("id", "last_updated") if old is not None else spark.createDataFrame([], "id string, last_updated timestamp")
    # counted while they are written, without a pass of their own
    seen = Observation()
    kinds = ["add", "update", "unchanged", "delete"]
    actions = table.set_aside(sync.diff(chunks, times, deletes).observe(seen, *[F.count_if(F.col("action") == k).alias(k) for k in kinds]))
    n = {k: seen.get[k] for k in kinds if seen.get[k]}
    todo = chunks.join(actions.where("action in ('add', 'update')").select("id"), "id", "left_semi")
    fresh = sync.embed(todo, embed_fn, "content", "embedding", settings.batch_rows).select(
        "id", "embedding", F.col("content").alias("document"), enrich.scalar_metadata(F.col("metadata"), F.col("last_updated").cast("string")).alias("metadata"), "last_updated"
    )
    if old is None or set(n) - {"unchanged"}:
        table.merge(fresh, actions.where("action = 'delete'").select("id") if "delete" in n else None)
    table.vacuum()
    return spark.createDataFrame(list(n.items()), "action string, n long")


def search(vectors: DataFrame, queries: DataFrame, k: int = Settings.top_k, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance, document, metadata) of the k nearest vectors; ids may be any strings."""
    hits = nearest(vectors.select("id", "embedding"), queries, k, metric)
    return hits.join(vectors.select("id", "document", "metadata"), "id").select("query_id", "rank", "id", "distance", "document", "metadata")


def answer(questions: DataFrame, vectors: DataFrame, embed_fn: Callable, answer_fn: Callable[[str], str], k: int | None = None, settings: Settings = Settings(), ledger: Ledger | None = None) -> DataFrame:
    """(query_id, question, answer, citations, page) of (query_id, question): retrieve, prompt, ask, classify, cite.

    k is the settings' top_k unless given. With a `ledger` no prompt is asked twice, whatever fails on the way.
    A call that takes longer than `answer_timeout_s` is an error answer. A question without any passage gets the no-information answer; a blank one the request to ask.
    """
    asks = sync.embed(questions, embed_fn, "question")
    hits = search(vectors, asks.select("query_id", "embedding"), k or settings.top_k)
    context, cites = A.contexts(hits), A.citations(hits)
    rows = questions.join(context, "query_id", "left").join(cites, "query_id", "left")
    asked = rows.withColumn("prompt", A.prompt(F.coalesce("question", F.lit("")), F.coalesce("context", F.lit(""))))
    reply_fn = A.limited(answer_fn, settings.answer_timeout_s)
    got = A.answered(asked, reply_fn) if ledger is None else A.answered_once(asked, ledger, reply_fn)
    reply = F.when(F.col("documents").isNull(), F.lit(A.P.NO_INFO)).otherwise(F.col("answer"))
    cited = F.coalesce("citations", F.array().cast("array<string>"))
    return got.select("query_id", "question", reply.alias("answer"), cited.alias("citations"), A.page(F.col("question"), reply, cited).alias("page"))


def flag_report(spark: SparkSession, folder: str, escape: bool = True) -> str:
    """The newest flag log as HTML, or a line that says there is none."""
    flags = readers.read_flags(spark, folder)
    if flags is None or flags.isEmpty():
        return "<h3>no flags</h3>"
    return report.html_table(report.flag_rows(flags), escape)
