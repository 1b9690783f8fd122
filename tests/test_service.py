"""Sources, writers, the whole flow and the driver's contract."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from palmleaf.config import META_KEYS, NOT_AVAILABLE, Settings
from palmleaf.operators import chunk, enrich, flatten, sync
from palmleaf.operators.ledger import Ledger
from palmleaf.plans import catalog, service
from palmleaf.plans.catalog import letter_model
from palmleaf.sources import docx as docx_source
from palmleaf.sources import readers, writers
from palmleaf.streaming.sync_stream import stream_sync

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_docx_to_records(spark, tmp_path):
    (tmp_path / "my book.docx").write_bytes(docx(["front", "---o0o---", "PHẨM II: Tên", "KINH một", "thân"]))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    paragraphs = readers.read_docx(spark, str(tmp_path))
    assert {r["doc_id"] for r in paragraphs.where("error is not null").collect()} == {"broken"}
    assert "table" not in {r["text"] for r in paragraphs.collect()}
    index = spark.createDataFrame([("My Book", {"Bộ": "b"})], "name string, meta map<string,string>")
    records = service.ingest(paragraphs.where("error is null"), index)
    (r,) = records.collect()
    assert r["file_name"] == "my_book_pham_02_phamiiten_kinh_001_kinhmot.json"
    assert r["noi_dung"] == ["PHẨM II: Tên", "KINH một", "thân"]
    assert r["metadata"]["Bộ"] == "b" and r["metadata"]["Số Phẩm"] == "PHẨM II: Tên" and set(r["metadata"]) == set(META_KEYS)
    writers.write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert readers.list_files(spark, str(tmp_path), ".DOCX", ignore_case=True).count() == 2


def test_docx_text():
    """Only runs and links directly below a paragraph: no tab stops of its properties, no text box twice, hyphens kept."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    box = "<w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent>"
    body = (
        '<w:p><w:pPr><w:tabs><w:tab w:val="left"/><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>KINH</w:t><w:tab/><w:t> A</w:t></w:r></w:p>'
        f"<w:p><w:r><w:t>KINH B</w:t><m:AlternateContent><m:Choice>{box}</m:Choice><m:Fallback>{box}</m:Fallback></m:AlternateContent></w:r></w:p>"
        "<w:p><w:r><w:t>a</w:t><w:noBreakHyphen/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p/>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    assert docx_source.docx_paragraphs(out.getvalue()) == ["KINH\t A", "KINH B", "a-b\nlink", ""]
    texts = ["a <b> & \"c\"", " x\ty\n ", "", "\x01\x0bé😀"]
    assert docx_source.docx_paragraphs(docx_source.docx_bytes(texts)) == [*texts[:3], "é😀"]


def test_docx_source(spark, tmp_path):
    """The data source reads what the reader reads, some files a partition, and errors are rows."""
    (tmp_path / "d").mkdir()
    for k in range(5):
        (tmp_path / "d" / f"b {k}.docx").write_bytes(docx_source.docx_bytes([f"line {k}", "x"] * k))
    (tmp_path / "d" / "bad.docx").write_bytes(b"no zip")
    good = bytearray(docx_source.docx_bytes(["some text of a file that is damaged later " * 20]))
    at = good.index(b"word/document.xml") + 40
    good[at : at + 20] = bytes(20)
    (tmp_path / "d" / "damaged.docx").write_bytes(bytes(good))
    (tmp_path / "d" / "UPPER.DOCX").write_bytes(docx_source.docx_bytes(["u"]))
    docx_source.register(spark)
    df = spark.read.format("docx").option("filesPerPartition", "2").load(str(tmp_path / "d"))
    rows = sorted(map(tuple, df.select("doc_id", "para_no", "text", F.col("error").isNull().alias("ok")).collect()), key=str)
    assert rows == sorted(map(tuple, readers.read_docx(spark, str(tmp_path / "d")).select("doc_id", "para_no", "text", F.col("error").isNull().alias("ok")).collect()), key=str)
    assert df.rdd.getNumPartitions() == 4 and {r[0] for r in rows if not r[3]} == {"bad", "damaged"} and len(rows) == 22
    assert spark.read.format("docx").option("ignoreCase", "true").load(str(tmp_path / "d")).where("doc_id = 'UPPER'").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("docx").load(str(tmp_path / "none")).count() == 0


def test_trees_that_are_odd(spark):
    """A bad record is an error row and others go on; columns of the caller stay whatever their names."""
    files = spark.createDataFrame([("a", '{"metadata": [1], "noi_dung": ["x"]}'), ("b", '{"metadata": {"k": 1}, "noi_dung": ["y"]}'), ("c", None)], "source_file string, value string")
    got = {r["source_file"]: (r["text"], r["error"] is not None) for r in flatten.parse_trees(files).collect()}
    assert got == {"a": (None, True), "b": ("y", False), "c": (None, True)}
    rows = spark.createDataFrame([("f", 3, "t. U", 7, 8, 9)], "source_file string, pos int, text string, at int, key int, content int")
    chunks = chunk.number_chunks(chunk.chunk_rows(rows))
    assert [(r["at"], r["key"], r["content"], r["doan_so"]) for r in chunks.collect()] == [(7, 8, "t. U", 1)]
    index = spark.createDataFrame([("t. U", {"Bộ": "b"})], "name string, meta map<string,string>")
    full = enrich.with_metadata(rows.withColumn("meta", F.lit(5)), "text", index).first()
    assert (full["key"], full["meta"], full["metadata"]["Bộ"]) == (8, 5, "b")
    assert flatten.first_occurrences(rows.withColumn("rank", F.lit(4))).first()["rank"] == 4


def test_indexes(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"a": {"Bộ": "x"}}))
    (tmp_path / "bad.json").write_text("{")
    assert [(r["name"], r["meta"]) for r in readers.read_metadata_index(spark, str(tmp_path / "i.json")).collect()] == [("a", {"Bộ": "x"})]
    with pytest.raises(ValueError, match="no metadata"):
        readers.read_metadata_index(spark, str(tmp_path / "bad.json"))
    assert readers.read_metadata_cache(spark, str(tmp_path / "missing.json")).count() == 0
    assert readers.read_metadata_cache(spark, str(tmp_path / "bad.json")).count() == 0


def test_chunk_sync_answer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.json").write_text(json.dumps({"metadata": {"Bộ": "B1"}, "noi_dung": ["aaaa.", "eeee.", "aaaa."]}), encoding="utf-8")
    chunks = service.chunk(readers.read_json_files(spark, str(tmp_path / "in")))
    assert [(r["content"], r["doan_so"], r["metadata"]["Bộ"]) for r in chunks.orderBy("doan_so").collect()] == [("aaaa.", 1, "B1"), ("eeee.", 2, "B1")]
    table = writers.VersionedTable(spark, str(tmp_path / "vectors"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    fixed = spark.read.parquet(str(tmp_path / "chunks"))
    assert {r["action"]: r["n"] for r in service.sync_vectors(fixed, table, letter_model).collect()} == {"add": 2}
    assert {r["action"]: r["n"] for r in service.sync_vectors(fixed, table, letter_model).collect()} == {"unchanged": 2}
    table.vacuum(1)
    assert table.read().count() == 2
    questions = spark.createDataFrame([(1, "aaa"), (2, " ")], "query_id long, question string")
    got = {r["query_id"]: r for r in service.answer(questions, table.read(), letter_model, lambda p: p[-12:], k=1).collect()}
    assert "aaaa." in got[1]["answer"] and got[1]["citations"] == ["Bộ: B1"] and "_ Bộ: B1_" in got[1]["page"]
    assert got[2]["page"] == "Vui lòng nhập câu hỏi."


def test_stream_is_idempotent(spark, tmp_path):
    schema = "id string, content string, metadata map<string,string>, last_updated timestamp"
    table = writers.VersionedTable(spark, str(tmp_path / "v"))
    for k, (text, day) in enumerate([("a", 1), ("b", 3), ("c", 2)]):
        spark.sql(f"select '1' as id, '{text}' as content, map('k', 'v') as metadata, timestamp'2024-01-0{day} 00:00:00' as last_updated").write.mode("append").parquet(str(tmp_path / "in"))
        stream_sync(spark, str(tmp_path / "in"), schema, table, letter_model, str(tmp_path / "cp")).awaitTermination()
    assert [(r["id"], r["document"]) for r in table.read().collect()] == [("1", "b")]


def test_merge_lays_changes_over_a_version(spark, tmp_path):
    table = writers.VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda ids, x: spark.createDataFrame([(str(k), x) for k in ids], "id string, x string")
    table.merge(rows(range(100), "a"))
    table.merge(rows([3, 4, 200], "b"), rows([7], None).select("id"))
    table.merge(rows([4, 7], "c"), rows([200, 999], None).select("id"))
    want = {str(k): "a" for k in range(100)} | {"3": "b", "4": "c", "7": "c"}
    assert {r["id"]: r["x"] for r in table.read().collect()} == want and table.read().count() == 100
    assert table._versions() == [1] and len(table._changes(1)) == 2
    table.merge(rows(range(50), "d"))
    assert table._versions() == [1, 2] and not table._changes(2)
    assert {r["id"]: r["x"] for r in table.read().collect()} == want | {str(k): "d" for k in range(50)}
    table.vacuum(1)
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == ["v=000000002"]


def scans(df):
    """(scan, the plan nodes above it) of every scan of files."""
    above, out = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [x for x in above if x[0] < depth]
        if "FileScan" in line:
            out.append((line, [x[1] for x in above]))
        above.append((depth, line))
    return out


def test_a_sync_reads_what_it_may_touch(spark, tmp_path, monkeypatch):
    """The table is neither shuffled nor, for a few ids, read beyond their buckets, with changes over its version or without."""
    monkeypatch.setattr(writers.VersionedTable, "COMPACT_SHARE", 0.9)
    table = writers.VersionedTable(spark, str(tmp_path / "t"), buckets=16)
    rows = lambda a, b, day: spark.range(a, b).selectExpr("cast(id as string) as id", "concat('text ', id) as content", "map('k', 'v') as metadata", f"timestamp'2024-01-0{day} 00:00:00' as last_updated")
    assert {r["action"]: r["n"] for r in service.sync_vectors(rows(0, 2000, 1), table, letter_model).collect()} == {"add": 2000}
    assert {r["action"]: r["n"] for r in service.sync_vectors(rows(1990, 2010, 2), table, letter_model).collect()} == {"update": 10, "add": 10}
    assert len(table._changes(1)) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        source = rows(0, 20, 3)
        whole = scans(sync.diff(source, table.current(source, "last_updated")))
        assert len(whole) == 2 and all("embedding" not in x for x, _ in whole)
        assert not any("Exchange" in x for _, above in whole for x in above)
        assert table.current(source, "last_updated").count() == 20
        few = table.current(source.where("id in ('3', '1995')"), "last_updated", few=["3", "1995"])
        assert all("SelectedBucketsCount: 2 out of 16" in x for x, _ in scans(few)) and few.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert table.read().count() == 2010
    # folders written with other numbers, or without buckets, stay readable
    again = writers.VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    again.merge(table.read().limit(1), None)
    assert again.read().count() == 2010


def test_repeated_and_null_ids(spark, tmp_path):
    schema = "id string, content string, metadata map<string,string>, last_updated timestamp"
    rows = spark.createDataFrame([("a", "x", None, None), ("a", "y", None, None), (None, "z", None, None), ("b", "q", None, None)], schema)
    table = writers.VersionedTable(spark, str(tmp_path / "v"))
    assert {r["action"]: r["n"] for r in service.sync_vectors(rows, table, letter_model).collect()} == {"add": 2}
    assert {r["action"]: r["n"] for r in service.sync_vectors(rows, table, letter_model).collect()} == {"unchanged": 2}
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b"]
    plain = spark.createDataFrame([("a", "2024-01-02", 1), ("a", "2024-01-03", 2), (None, "2024-01-03", 3)], "id string, last_updated string, n int")
    got = sync.apply_changes(plain, plain.where("n = 1")).collect()
    assert [(r["id"], r["n"]) for r in got] == [("a", 2)]


def test_flags(spark, tmp_path):
    assert service.flag_report(spark, str(tmp_path / "none")) == "<h3>no flags</h3>"
    (tmp_path / "dataset1.csv").write_bytes('r,timestamp\r\n"<h3>a\nb""c</h3>",2025-05-20 16:22:25.648525\n,2025-05-20 16:28:07.1\n'.encode())
    html = service.flag_report(spark, str(tmp_path))
    assert html.index("16:28:07") < html.index("16:22:25") and "&lt;h3&gt;a" in html


def test_settings(spark):
    assert Settings.load(spark).chunk_chars == 512
    spark.conf.set("palmleaf.chunk_chars", "100")
    assert Settings.load(spark).chunk_chars == 100
    spark.conf.unset("palmleaf.chunk_chars")
    with pytest.raises(ValueError, match="vector_table"):
        Settings.load(spark, required=("vector_table",))
    assert NOT_AVAILABLE == "Not_Available"


def test_settings_are_used(spark, tmp_path):
    """Lengths of titles, the number of passages, the vector table, and the rate of calls come from the settings."""
    few = Settings(title_chars=4, name_chars=12, top_k=1, vector_table=str(tmp_path / "v"), documents_per_minute=600)
    paragraphs = spark.createDataFrame([("b", k, t) for k, t in enumerate(["---o0o---", "1. KINH dài", "thân", "---o0o---"])], "doc_id string, para_no int, text string")
    index = spark.createDataFrame([("b", {"Bộ": "x"})], "name string, meta map<string,string>")
    assert service.ingest(paragraphs, index, settings=few).first()["file_name"] == "b_kinh_001_1.json"[:12] + ".json"
    assert service.ingest(paragraphs, index, 1, settings=few).first()["file_name"].endswith("_kinh_001_1. K.json")
    with pytest.raises(ValueError, match="vector_table"):
        service.vector_table(spark, Settings())
    chunks = spark.sql("select stack(2, 'a', 'aaaa.', 'b', 'eeee.') as (id, content)").selectExpr("id", "content", "map('Bộ', id) as metadata", "timestamp'2024-01-01 00:00:00' as last_updated")
    table = service.vector_table(spark, few)
    assert {r["action"]: r["n"] for r in service.sync_vectors(chunks, table, letter_model, few).collect()} == {"add": 2}
    ledger = Ledger(spark, str(tmp_path / "l"))
    asks = spark.createDataFrame([(1, "aaa")], "query_id long, question string")
    for model in (lambda p: "said", lambda p: 1 / 0):
        got = service.answer(asks, table.read(), letter_model, model, settings=few, ledger=ledger).first()
        assert got["answer"] == "said" and got["citations"] == ["Bộ: a"]
    books = spark.createDataFrame([("q",), ("r",)], "book string")
    for fn in (lambda n: {"STT": n}, lambda n: 1 / 0):
        got = service.enrich_cache(books, "book", str(tmp_path / "c"), fn, ledger, few)
        assert {r["name"]: r["meta"]["STT"] for r in got.collect()} == {"q": "q", "r": "r"}


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def shape(rows):
    return sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert shape(got[cols].itertuples(index=False)) == shape(want[cols].itertuples(index=False))
