"""The registered queries: the library's operators over the driver's tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palmleaf.functions import patterns as P
from palmleaf.functions import text as T
from palmleaf.operators import answer as A
from palmleaf.operators import chunk, enrich, flatten, report, segment, sync
from palmleaf.operators.ledger import Ledger
from palmleaf.operators.search import nearest
from palmleaf.operators.vector_index import VectorIndex, recall
from palmleaf.plans import service
from palmleaf.plans.oracles import oracle_sql
from palmleaf.shared import materialize, scratch
from palmleaf.sources import docx, readers, writers

__all__ = ["oracle_sql", "queries"]

_ALL: dict = {}


def _query(f):
    _ALL[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_ALL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval


def _hits(spark: SparkSession, sf_dir: str, metric: str = "l2") -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return nearest(v, v.withColumnRenamed("id", "query_id"), 5, metric, skip_self=True)


@_query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector, squared Euclidean."""
    return _hits(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@_query
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "cosine").withColumn("distance", F.round("distance", 6))


@_query
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every twentieth vector in an index of all of them, and whether nine tenths of the true neighbours are among all hits."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asks = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v, scratch(spark, "index"), parts=32)
    probes = index.probes_for(0.97)
    found = materialize(index.search(asks, 5, probes=probes, refine=index.refine_for(probes, 0.94), skip_self=True))
    share = recall(found, nearest(v, asks, 5, skip_self=True)).select((F.col("found") >= 0.9 * F.col("wanted")).alias("recall_ok"))
    hits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    indexed = index.lists().agg(F.count(F.lit(1)).alias("indexed"))
    # both are one row
    return hits.withColumn("recall_ok", F.lit(share.first()["recall_ok"])).withColumn("indexed", F.lit(indexed.first()["indexed"]))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, id, document, metadata): the five nearest of the vectors that have a document, for each of them."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source")
    # read several times, so the join is written once
    v = materialize(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs.select("id"), "id", "left_semi"))
    hits = nearest(v, v.withColumnRenamed("id", "query_id"), 5, skip_self=True)
    meta = F.create_map(F.lit("Bộ"), F.col("source"), F.lit("Tên Kinh Đầy Đủ"), F.col("lang"), F.lit("Việt Dịch"), F.lit(""))
    return hits.join(docs, "id").select("query_id", "rank", "id", "document", meta.alias("metadata"))


@_query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every question: instruction and its five nearest passages."""
    got = A.contexts(_passages(spark, sf_dir))
    prompt = A.prompt(F.concat(F.lit("question "), F.col("query_id").cast("string")), F.col("context"))
    return got.select("query_id", F.length(prompt).cast("long").alias("prompt_chars"), F.md5(prompt).alias("prompt_md5"))


@_query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.citations(_passages(spark, sf_dir)).select("query_id", F.array_join("citations", " | ").alias("citations"))


# ---- text


@_query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_rows(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "content")


@_query
def chunk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk numbers that run through all documents of a source."""
    rows = chunk.chunk_rows(_t(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return chunk.number_chunks(rows, "source", ("doc_id", "chunk_no")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "source", F.col("doan_so").cast("long").alias("doan_so"))


@_query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.sentences(F.col("text"))).alias("no", "sentence"))
    return rows.select("doc_id", F.col("no").cast("long").alias("no"), "sentence")


@_query
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken apart and put together again."""
    x = T.nfc(T.nfd("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("chars"), F.md5(x).alias("text_md5"))


@_query
def match_key_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.match_key_a(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("chars"), F.md5(x).alias("key_md5"))


@_query
def match_key_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.match_key_b(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("chars"), F.md5(x).alias("key_md5"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))


@_query
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.clean_paragraphs(_lines(spark, sf_dir)).select("doc_id", F.col("para_no").cast("long").alias("para_no"), "text")


@_query
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.whole_documents(_lines(spark, sf_dir)).select("doc_id", F.md5("body").alias("body_md5"))


@_query
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of segment file names, from parts' names as titles."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("size"))
    slug = F.left(T.match_key_a(F.col("p_name")), F.lit(50))
    v1 = T.segment_name_v1(F.lit("book"), F.col("size"), F.col("size") + 1, F.col("p_name"))
    v2 = T.segment_name_v2(F.lit("a book"), F.col("size") - 25, slug, F.col("size"), slug)
    return p.select("p_partkey", v1.alias("name_v1"), v2.alias("name_v2"))


@_query
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.known_name(T.base_name(F.concat(F.lit("in/"), F.col("n_name"), F.lit("-x y.docx")), hyphens=True), {"NATION_1_x_y": "first"})
    return _t(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"))


@_query
def roman_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written as roman numerals and read again."""
    n = F.col("p_partkey") % 3999 + 1
    digit = lambda marks, k: F.get(F.split(F.lit(marks), ","), (F.expr(f"(p_partkey % 3999 + 1) div {10**k}") % 10).cast("int"))
    text = F.concat(
        digit(",M,MM,MMM", 3), digit(",C,CC,CCC,CD,D,DC,DCC,DCCC,CM", 2), digit(",X,XX,XXX,XL,L,LX,LXX,LXXX,XC", 1), digit(",I,II,III,IV,V,VI,VII,VIII,IX", 0)
    )
    return _t(spark, sf_dir, "part").select("p_partkey", n.cast("long").alias("expected"), P.chapter_number(text).cast("long").alias("value"))


# ---- segments: conversations as paragraph streams; roles and turns choose headings and delimiters


def _stream_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    text = F.when(F.col("role") == "system", F.concat(turn, F.lit(". PHẨM "), F.col("role"))).when(F.col("role") == "user", F.concat(turn, F.lit(". KINH "), turn))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), F.coalesce(text, "text").alias("text"))


def _stream_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 3 == 0, F.lit("--- x ---o0o---")).when((F.col("role") == "user") & (F.col("turn") % 4 == 2), F.concat(F.lit("PHẦN "), turn, F.lit(": name"))).when(
        F.col("role") == "user", F.concat(F.lit("KINH "), turn)
    )
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), F.coalesce(text, F.concat(F.lit("- "), F.col("text"))).alias("text"))


@_query
def segment_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.running_v1(_stream_v1(spark, sf_dir)).select(
        "doc_id", "para_no", F.col("segment").cast("long").alias("segment"), F.col("chapter_no").cast("long").alias("chapter_no"), "chapter_title", "title", F.col("number").cast("long").alias("number")
    )


@_query
def segment_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments_v1(_stream_v1(spark, sf_dir)).select(
        "doc_id", F.col("segment").cast("long").alias("segment"), "title", "label", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5")
    )


@_query
def segment_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments under the second strategy."""
    return segment.segments_v2(_stream_v2(spark, sf_dir)).select(
        "doc_id", F.col("segment").cast("long").alias("segment"), F.col("chapter_no").cast("long").alias("chapter_no"), "chapter_title", F.col("number").cast("long").alias("number"), "title",
        F.md5(F.array_join("lines", "\n")).alias("lines_md5"),
    )


@_query
def structure_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = segment.running_v1(_stream_v1(spark, sf_dir))
    return state.groupBy("doc_id").agg(segment.structure_label(F.bool_or("is_chapter"), F.bool_or("is_sutra")).alias("label"))


def _book_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of books named like conversations, from documents; those in German are missing from it."""
    d = _t(spark, sf_dir, "documents").where("lang <> 'de'")
    return d.select(F.col("doc_id").cast("string").alias("name"), F.create_map(F.lit("Bộ"), F.col("source"), F.lit("Tên Kinh Đầy Đủ"), F.col("lang")).alias("meta"))


def _record_columns(records: DataFrame) -> DataFrame:
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return records.select(
        "file_name", value("Bộ").alias("bo"), value("Số Phẩm").alias("chapter"), value("Tên Kinh Nhỏ").alias("sutra"), value("Chia Đoạn").alias("label"),
        F.size("metadata").cast("long").alias("n_keys"), F.size("noi_dung").cast("long").alias("n_lines"), F.md5(F.array_join("noi_dung", "\n")).alias("lines_md5"),
    )


@_query
def ingest_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment records of the first strategy, with names, book metadata and labels."""
    return _record_columns(service.ingest(_stream_v1(spark, sf_dir), _book_index(spark, sf_dir), strategy=1))


@_query
def ingest_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment records of the second strategy; some lines are delimiters too short to cut, which only saving drops."""
    c = _stream_v2(spark, sf_dir)
    short = (F.col("para_no") % 5 == 1) & F.col("text").startswith("- ")
    return _record_columns(service.ingest(c.withColumn("text", F.when(short, "--o0o--").otherwise(F.col("text"))), _book_index(spark, sf_dir)))


@_query
def chapter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter numbers under the second strategy where some headings have words, which count on from the chapter before."""
    c = _t(spark, sf_dir, "conversations")
    number = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("turn").cast("string")).otherwise("Nhất")
    text = F.when(F.col("turn") == 0, "---o0o---").when(F.col("role") == "user", F.concat(F.lit("CHƯƠNG THỨ "), number)).otherwise(F.concat(F.lit("- "), F.col("text")))
    rows = segment.running_v2(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), text.alias("text")))
    return rows.select("doc_id", "para_no", F.col("chapter_no").cast("long").alias("chapter_no"), "chapter_title")


@_query
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-document records with book metadata, written out and read again."""
    books = enrich.with_metadata(segment.whole_documents(_lines(spark, sf_dir)).withColumn("__book", F.col("doc_id").cast("string")), "__book", _book_index(spark, sf_dir))
    folder = scratch(spark, "records")
    writers.write_records(writers.whole_document_records(books), folder, as_json=False)
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return spark.read.parquet(folder).select("file_name", value("Bộ").alias("bo"), value("Chia Đoạn").alias("label"), F.md5("noi_dung_full_doc").alias("body_md5"))


@_query
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each region, with its nations as lines; read as segment records."""
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("noi_dung"))
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.create_map(F.lit("Bộ"), F.col("r_name")).alias("metadata"))
    folder = scratch(spark, "json")
    n.join(r, "n_regionkey").repartition("n_regionkey").write.mode("overwrite").partitionBy("n_regionkey").json(folder)
    return readers.read_segments(spark, folder).select(F.try_element_at("metadata", F.lit("Bộ")).alias("bo"), F.array_join("noi_dung", ",").alias("lines"))


@_query
def docx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOCX file for each conversation, its turns as paragraphs, written by tasks and read through the data source."""
    folder = scratch(spark, "docx")
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), "text")
    docx.write_docx(c, folder)
    docx.register(spark)
    return spark.read.format("docx").load(folder).select("doc_id", F.col("para_no").cast("long").alias("para_no"), F.md5("text").alias("text_md5"), F.col("error").isNotNull().alias("failed"))


@_query
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX files of all conversations, as a folder lists them: paragraphs read, books looked up in an index that must be there and a cache that isn't."""
    folder = scratch(spark, "files")
    c = _t(spark, sf_dir, "conversations")
    opens = c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"))
    named = c.join(opens, "conv_id").select(F.concat_ws("-", "first", F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("para_no"), "text")
    docx.write_docx(named, f"{folder}/docx")
    # one object for each role
    entries = c.select("role").distinct().agg(F.collect_list(F.struct("role", F.create_map(F.lit("Bộ"), F.concat(F.lit("book "), F.col("role"))).alias("meta"))).alias("e"))
    entries.select(F.to_json(F.map_from_entries("e"))).coalesce(1).write.text(f"{folder}/index")
    index, cache = readers.read_metadata_index(spark, f"{folder}/index"), readers.read_metadata_cache(spark, f"{folder}/cache")
    read = readers.read_docx(spark, f"{folder}/docx").where("error is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    full = enrich.with_metadata(read.withColumn("book", F.regexp_extract("doc_id", "^[^-]*", 0)), "book", index.unionByName(cache))
    listed = readers.list_files(spark, f"{folder}/docx", ".DOCX", ignore_case=True).select(T.base_name(F.col("name")).alias("doc_id"), (F.col("length") > 0).alias("filled"))
    return listed.join(full, "doc_id", "left").select("doc_id", "filled", "paragraphs", F.try_element_at("metadata", F.lit("Bộ")).alias("bo"))


@_query
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each conversation, in the four forms that roots have, by turns; flattened, with inherited scalars."""
    own = F.create_map(F.lit("k"), F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = c.withColumn("nodes", F.transform("t", lambda x: F.struct(F.lit("paragraph").alias("type"), x["text"].alias("text"), x["turn"].cast("string").alias("turn"))))
    key = own["k"].alias("k")
    form = F.col("conv_id") % 4
    value = (
        F.when(form == 0, F.to_json(F.struct(key, F.col("nodes").alias("Noi_Dung"))))
        .when(form == 1, F.to_json(F.struct(key, F.lit("chapter").alias("type"), F.col("nodes").alias("content"))))
        .when(form == 2, F.to_json(F.col("nodes")))
        .otherwise(F.to_json(F.struct(own.alias("metadata"), F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("noi_dung"))))
    )
    got = flatten.flatten(c.select(F.col("conv_id").cast("string").alias("source_file"), value.alias("value")))
    of = lambda k: F.try_element_at("metadata", F.lit(k))
    return got.select("source_file", F.row_number().over(Window.partitionBy("source_file").orderBy("pos")).cast("long").alias("no"), F.md5("text").alias("text_md5"), of("k").alias("k"), of("turn").alias("turn"))


@_query
def normalized_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed texts, written in normal form C and read again."""
    folder = scratch(spark, "nfc")
    writers.write_normalized(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), T.nfd("text").alias("value")), folder)
    return spark.read.parquet(folder).select("source_file", F.md5("value").alias("value_md5"))


# ---- trees and metadata


@_query
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return flatten.first_occurrences(docs, ("lang",), "text", ("doc_id",)).select("lang", "doc_id")


@_query
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content tree for each nation, of its customers with their market segments below a node of another type; flattened, first texts only."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    leaf = F.struct(F.lit("paragraph").alias("type"), F.concat(F.lit("  "), F.col("c_mktsegment")).alias("tieu_de"))
    node = F.struct(F.col("c_custkey").alias("key"), F.lit("van_xuoi").alias("type"), F.col("c_name").alias("text"), F.array(F.struct(F.lit("note").alias("type"), F.array(leaf).alias("Noi_Dung"))).alias("content"))
    trees = _t(spark, sf_dir, "customer").join(n, "c_nationkey").groupBy("n_name").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    files = trees.select(F.col("n_name").alias("source_file"), F.to_json(F.struct(F.lit("x").alias("own"), F.col("nodes").alias("Noi_Dung"))).alias("value"))
    got = flatten.first_occurrences(flatten.flatten(files))
    return got.select("source_file", "pos", "text", F.try_element_at("metadata", F.lit("key")).alias("key"), F.try_element_at("metadata", F.lit("own")).alias("own"))


@_query
def metadata_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations by a match key that ignores case, accents and hyphens; nations of one region are missing from the index."""
    r = _t(spark, sf_dir, "region")
    index = _t(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(
        F.col("n_name").alias("name"), F.create_map(F.lit("Bộ"), F.col("r_name")).alias("meta")
    )
    book = F.concat(F.lit(" Nátiòn-"), F.col("c_nationkey").cast("string"))
    got = enrich.with_metadata(_t(spark, sf_dir, "customer").select("c_custkey", book.alias("book")), "book", index)
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return got.select("c_custkey", value("Bộ").alias("bo"), value("Ghi chú").alias("ghi_chu"), F.size("metadata").cast("long").alias("n_keys"))


@_query
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("Bộ"), F.col("r_name"), F.lit("other"), F.lit("gone"))
    full = enrich.overlay(enrich.fill_template(meta), {"Số Phẩm": F.col("r_regionkey")})
    return _t(spark, sf_dir, "region").select("r_regionkey", F.array_join(F.array_sort(F.transform(F.map_entries(full), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("filled"))


@_query
def metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.from_json("props", "map<string,string>")
    got = enrich.scalar_metadata(F.map_concat(meta, F.create_map(F.lit("none"), F.lit(None).cast("string"))), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _t(spark, sf_dir, "events").select("event_id", F.size(got).cast("long").alias("n"), F.try_element_at(got, F.lit("k")).alias("k"), F.try_element_at(got, F.lit("last_updated")).alias("last_updated"))


def ask_about(name: str) -> dict | None:
    """A stand-in for a metadata service: it knows books with even numbers, fails at multiples of three and finds no other."""
    number = int(name.rsplit("-", 1)[1])
    if number % 3 == 0:
        raise ConnectionError("no answer")
    return {"Bộ": f"asked {number}", "Ghi chú": ""} if number % 2 == 0 else None


@_query
def enrich_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after its misses were asked for, as written and read again; nations of one region are missing from it."""
    r = _t(spark, sf_dir, "region")
    cache = _t(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(
        F.col("n_name").alias("name"), F.create_map(F.lit("Bộ"), F.col("r_name")).alias("meta")
    )
    books = _t(spark, sf_dir, "customer").select(F.concat(F.lit("Nátiòn-"), F.col("c_nationkey").cast("string")).alias("book"))
    folder = scratch(spark, "cache")
    writers.write_cache(enrich.enrich_misses(books, "book", cache, ask_about), folder)
    value = lambda k: F.try_element_at("meta", F.lit(k))
    return writers.VersionedTable(spark, folder).read().select("name", value("Bộ").alias("bo"), value("Ghi chú").alias("ghi_chu"), F.size("meta").cast("long").alias("n_keys"))


# ---- sync


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source: the last time of every user and kind of event; target: that of their events of a high value only."""
    e = _t(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    last = lambda df: df.groupBy("id").agg(F.max("ts").alias("last_updated"), F.count(F.lit(1)).alias("n"))
    return last(e), last(e.where("value > 60"))


@_query
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(*_sides(spark, sf_dir))


@_query
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.apply_changes(*_sides(spark, sf_dir)).select("id", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "n")


@_query
def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector table after two syncs: all documents, then those of one source with new texts and those of another gone. The model is a stand-in."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"))
    rows = docs.select("id", "content", "source", F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_updated"))
    changed = rows.where("source = 'src3'").withColumns({"content": F.concat(F.lit("new "), F.col("content")), "last_updated": F.lit("2024-02-01 00:00:00").cast("timestamp")})
    table = writers.VersionedTable(spark, scratch(spark, "changes"))
    service.sync_vectors(rows.drop("source"), table, letter_model)
    # a repeated row, an older one and the new ones; then the deletion of what the source no longer has
    service.sync_vectors(changed.unionByName(changed).unionByName(rows.where("source = 'src3'")).drop("source"), table, letter_model)
    left = rows.where("source not in ('src3', 'src5')").unionByName(changed)
    service.sync_vectors(left.drop("source"), table, letter_model, deletes=True)
    return table.read().select("id", F.md5("document").alias("document_md5"), F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"))


@_query
def sync_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference where times are text, some of it missing or malformed on either side; ids that only the target has are deletes."""
    e = _t(spark, sf_dir, "events")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    late = F.date_format(F.col("ts") + F.expr("interval 1 day"), "yyyy-MM-dd HH:mm:ss")
    source = e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "no time").when(F.col("value") > 80, F.lit(None)).otherwise(at).alias("last_updated"))
    target = e.where("value > 20").select(F.col("event_id").alias("id"), F.when(F.col("value") < 40, "").when(F.col("value") < 60, late).otherwise(at).alias("last_updated"))
    return sync.diff(source, target, deletes=True)


@_query
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id")
    return sync.batch_numbers(e, F.col("event_id"), F.expr("event_id div 5000"))


# ---- answers and reports


@_query
def answer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "system", F.concat(F.lit(P.ERROR_PREFIX), F.col("text"))).when(F.col("turn") % 5 == 3, F.concat(F.col("text"), F.lit(" Không có thông tin này."))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", A.answer_kind(said).alias("kind"))


@_query
def answer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "system", F.lit(P.NO_INFO)).otherwise(F.col("text"))
    cites = F.when(F.col("role") == "user", F.array(F.lit("Bộ: a"), F.lit("Kinh: b"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", F.md5(A.page(F.when(F.col("turn") > 0, "q").otherwise(" "), A.settled(said), cites)).alias("page_md5"))


def count_model(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: counts of a few letters, whole numbers, so distances are exact."""
    return [[float(t.count(c)) for c in "aeio"] for t in texts]


def reply_model(prompt: str) -> str:
    """A stand-in for a language model: the prompt's end, or an error, or that it found nothing, by the prompt's length."""
    if len(prompt) % 7 == 0:
        raise ValueError("too busy")
    return "Tôi không tìm thấy thông tin." if len(prompt) % 5 == 0 else "A: " + prompt[-60:]


@_query
def answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a question to the documents: embedded, retrieved, prompted, answered, cited; first turns are blank."""
    c = _t(spark, sf_dir, "conversations")
    asks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") == 0, " ").otherwise(F.col("text")).alias("question"))
    meta = F.create_map(F.lit("Bộ"), F.col("source"), F.lit("Tên Kinh Đầy Đủ"), F.col("lang"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), meta.alias("metadata"))
    got = service.answer(asks, sync.embed(docs, count_model, "document"), count_model, reply_model)
    return got.select("query_id", F.md5("answer").alias("answer_md5"), F.array_join("citations", " | ").alias("citations"), F.md5("page").alias("page_md5"))


def echo_model(prompt: str) -> str:
    """A stand-in for an answering model."""
    return f"told {prompt}"


@_query
def ledger_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to every turn of every conversation through a ledger, asked for twice: the second time all of them are in it."""
    ledger = Ledger(spark, scratch(spark, "ledger"), batch=500)
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    A.answered_once(c, ledger, echo_model)
    got = A.answered_once(c, ledger, silent_model)
    return got.select("conv_id", "turn", F.md5("answer").alias("answer_md5"))


def silent_model(prompt: str) -> str:
    """A stand-in for a model that is down."""
    raise ConnectionError("no answer")


@_query
def flag_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flag logs, of regions and of nations, one file each; the newer is read and reported, rows without a time left out."""
    folder = scratch(spark, "flags")
    for table, name, key in (("region", "r_name", "r_regionkey"), ("nation", "n_name", "n_regionkey")):
        stamp = F.when(F.col(key) == 3, "no time").otherwise(F.concat(F.lit("2025-05-2"), F.col(key).cast("string"), F.lit(" 16:21:55.588567")))
        log = _t(spark, sf_dir, table).select(F.concat(F.lit('<h3>"'), F.col(name), F.lit('",\n</h3>')).alias("text"), stamp.alias("timestamp"))
        log.coalesce(1).write.mode("append").csv(folder, header=True, escape='"')
    return report.flag_rows(readers.read_flags(spark, folder, "part-*.csv"))


@_query
def flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    stamp = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(F.col("ts").cast("string"))
    return report.flag_rows(e.select("event_id", stamp.alias("timestamp")))


@_query
def flag_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html_lines(_t(spark, sf_dir, "events").select("event_id", "props", "event_type"))


@_query
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.counts(_t(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@_query
def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents arrive as a stream and are merged into a vector table; its final state. The model is a stand-in."""
    from palmleaf.streaming.sync_stream import stream_sync as start

    folder = scratch(spark, "stream")
    docs = chunk.chunk_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("id"), "content",
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_updated"),
    )
    rows.write.parquet(f"{folder}/in")
    table = writers.VersionedTable(spark, f"{folder}/vectors")
    schema = "id string, content string, metadata map<string,string>, last_updated timestamp"
    start(spark, f"{folder}/in", schema, table, letter_model, f"{folder}/state").awaitTermination()
    return table.read().select("id", F.md5("document").alias("document_md5"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


def letter_model(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: shares of a few letters."""
    return [[t.count(c) / max(1, len(t)) for c in "aeio"] for t in texts]
