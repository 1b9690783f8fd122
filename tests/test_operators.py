"""Segments, chunks, trees, metadata, sync, search and answers against plain Python on small cases."""

import json
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palmleaf.config import META_KEYS, NOT_AVAILABLE, UNKNOWN
from palmleaf.operators import answer as A
from palmleaf.operators import chunk, enrich, flatten, report, segment, sync
from palmleaf.operators.search import nearest, nearest_approximate


def greedy(text, most=512):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+(?=[A-ZĐ])", text):
        if len(cur) + len(s) + 1 <= most:
            cur += s + " "
        else:
            out += [cur.strip()] if cur else []
            cur = s + " "
    return [*out, cur.strip()]


def paragraphs(spark, docs):
    rows = [(d, k, t) for d, texts in docs.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, para_no int, text string")


def by_doc(df, *cols):
    out = {}
    for r in df.orderBy("doc_id", "segment").collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return out


def test_segments_v1_edge_cases(spark):
    docs = {
        "plain": ["a", " ", "b", "o0o"],  # no heading: one whole segment
        "one": ["a"],
        "front1": ["a", "1. KINH x", "b"],  # a single paragraph before a heading is lost
        "front2": ["a", "b", "1. KINH x", "c"],  # two are kept, and the number goes on
        "chapter": ["PHẨM x", "a", "b"],  # text under a chapter alone is lost
        "both": ["PHẨM x", "lost", "1. KINH y", "c", "---o0o---", "d", "PHẦN 2", "2. KINH z", "e"],
    }
    got = by_doc(segment.segments_v1(paragraphs(spark, docs)), "number", "title", "chapter_no", "chapter_title", "label", "lines")
    assert got == {
        "plain": [(1, "plain_full", 0, UNKNOWN, UNKNOWN, ["a", "b"])],
        "one": [(1, "one_full", 0, UNKNOWN, UNKNOWN, ["a"])],
        "front1": [(1, "1. KINH x", 0, UNKNOWN, "Theo kinh nhỏ", ["b"])],
        "front2": [(1, "front2_full", 0, UNKNOWN, "Theo kinh nhỏ", ["a", "b"]), (2, "1. KINH x", 0, UNKNOWN, "Theo kinh nhỏ", ["c"])],
        "both": [
            (1, "1. KINH y", 1, "PHẨM x", "Theo phẩm, theo kinh nhỏ", ["c", "d"]), (1, "2. KINH z", 2, "PHẦN 2", "Theo phẩm, theo kinh nhỏ", ["e"]),
        ],
    }
    literal = by_doc(segment.segments_v1(paragraphs(spark, docs), literal_labels=True), "label")
    assert literal["both"] == [(UNKNOWN,), ("Theo phẩm, theo kinh nhỏ",)]


def test_segments_v2_edge_cases(spark):
    docs = {
        "none": ["a", "b"],  # no delimiter, no segments
        "mixed": ["lost", "x ---O0o--- y", "PHẨM Nhất: đầu", "a", "KINH k", "b", "---o0o---", "c", "---o0o---", "CHƯƠNG III", "PHẦN Hai: hai", "d"],
    }
    got = by_doc(segment.segments_v2(paragraphs(spark, docs)), "chapter_no", "chapter_title", "number", "title", "lines")
    assert list(got) == ["mixed"]
    first, second, third = got["mixed"]
    assert first[0] == 1 and first[2:] == (1, "KINH k", ["PHẨM Nhất: đầu", "a", "KINH k", "b"])
    assert second[2:] == (1, "KINH k", ["c"])  # titles carry on
    assert third[0] == 4 and third[2:4] == (0, UNKNOWN)  # a word counts on from III, and a chapter resets the sutra
    whole = {r["doc_id"]: r["body"] for r in segment.whole_documents(paragraphs(spark, {"d": ["a", " ", " b "]})).collect()}
    assert whole == {"d": "a\n\nb"}


def test_saved_lines(spark):
    df = spark.createDataFrame([(["a", " ", "--o0o--", "b", "---o0o---", "o0o"],)], "x array<string>")
    assert df.select(segment.without_delimiter_lines(F.col("x"))).first()[0] == ["a", "b", "o0o"]
    assert df.select(segment.without_delimiter_lines(F.col("x"), trailing_only=True)).first()[0] == ["a", " ", "--o0o--", "b"]


TEXTS = st.lists(st.text("abc ABĐ.!? \n", min_size=1, max_size=80).filter(str.strip), min_size=1, max_size=12)


@given(TEXTS)
@settings(max_examples=8, deadline=None)
def test_chunks_are_greedy(spark, texts):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    got = {}
    for r in chunk.chunk_rows(df, most=40).orderBy("k", "chunk_no").collect():
        got.setdefault(r["k"], []).append(r["content"])
    assert got == {k: greedy(x, 40) for k, x in enumerate(texts)}


def test_chunk_bounds_and_numbers(spark):
    texts = [None, " ", "A" * 600 + ". Bc.", "A" * 255 + ". " + "B" * 254 + ". C."]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(texts)], "source_file string, pos int, text string")
    got = [(r["pos"], r["doan_so"], r["content"]) for r in chunk.number_chunks(chunk.chunk_rows(df)).orderBy("doan_so").collect()]
    assert got == [(k, n + 1, c) for n, (k, c) in enumerate([(k, c) for k, x in enumerate(texts) if x and x.strip() for c in greedy(x)])]


def test_ordinals_run_through_stretches(spark):
    """More nodes than one stretch has, some without chunks, files and extra columns apart."""
    rows = spark.range(2 * chunk.STRETCH + 50).where("id % 7 <> 0").selectExpr("if(id % 3 = 0, 'a', null) as source_file", "id as pos", "0 as chunk_no", "id as doan_so", "id as extra")
    got = chunk.number_chunks(rows).orderBy("pos").collect()
    n = {}
    for r in got:
        n[r["source_file"]] = n.get(r["source_file"], 0) + 1
        assert r["doan_so"] == n[r["source_file"]] and r["extra"] == r["pos"]
    assert len(got) == rows.count()


def test_trees(spark):
    files = {
        "root_list": [{"type": "paragraph", "text": "a", "n": 1, "none": None}, "skipped", {"type": "x", "text": "no", "content": [{"type": "tụng", "tieu_de": " b ", "n": True}]}],
        "noi_dung": {"own": "gone", "Noi_Dung": [{"type": "paragraph", "text": "a"}, {"type": "paragraph", "text": "a"}]},
        "both": [{"type": "van_xuoi", "text": "", "tieu_de": "t", "k": "v", "content": [{"type": "paragraph", "text": "c"}], "Noi_Dung": [{"type": "paragraph", "text": "lost"}]}],
        "bad_text": [{"type": "paragraph", "text": "a"}, {"type": "paragraph", "text": 5}],
        "scalar": 7,
        "record": {"metadata": {"Bộ": "x"}, "noi_dung": ["p", "q"]},
    }
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [("broken", "{"), ("null", None)]
    nodes = flatten.flatten(spark.createDataFrame(rows, "source_file string, value string"))
    got = {}
    for r in flatten.first_occurrences(nodes).orderBy("source_file", "pos").collect():
        got.setdefault(r["source_file"], []).append((r["text"], {k: v for k, v in r["metadata"].items() if k in ("n", "own", "none", "k", "Bộ")}))
    assert got == {
        "root_list": [("a", {"n": "1", "none": None}), ("b", {"n": "true"})],
        "noi_dung": [("a", {})],
        "both": [("t", {"k": "v"}), ("c", {"k": "v"})],
        "record": [("p", {"Bộ": "x"}), ("q", {"Bộ": "x"})],
    }
    errors = flatten.parse_trees(spark.createDataFrame(rows, "source_file string, value string")).where("error is not null")
    assert {r["source_file"] for r in errors.collect()} == {"bad_text", "scalar", "broken", "null"}


def test_metadata(spark):
    index = spark.createDataFrame([("Kinh Ðoạn-A", {"Bộ": "x", "STT": None}), ("other", {"Bộ": "y"})], "name string, meta map<string,string>")
    rows = spark.createDataFrame([("kinh ðoàn a",), ("nothing",), ("Fails",), (None,)], "book string")
    got = {r["book"]: r["metadata"] for r in enrich.with_metadata(rows, "book", index).collect()}
    assert got["kinh ðoàn a"]["Bộ"] == "x" and got["kinh ðoàn a"]["STT"] == NOT_AVAILABLE
    assert set(got["nothing"]) == set(META_KEYS) and set(got["nothing"].values()) == {NOT_AVAILABLE}
    calls = enrich.enrich_misses(rows, "book", index, lambda n: {"Bộ": n.upper()} if n == "nothing" else 1 / 0)
    cache = {r["name"]: r["meta"] for r in calls.collect()}
    assert cache["nothing"]["Bộ"] == "NOTHING" and cache["Fails"]["Bộ"] == NOT_AVAILABLE and cache["other"] == {"Bộ": "y"} and "kinh ðoàn a" not in cache


def test_throttle():
    import time

    began = time.monotonic()
    assert [enrich.throttled(str, 1200)(k) for k in range(2)] == ["0", "1"]
    slow = enrich.throttled(str, 600)
    assert [slow(k) for k in range(3)] == ["0", "1", "2"] and time.monotonic() - began >= 0.2


def test_sync(spark):
    s = spark.createDataFrame([("a", "2024-01-02", 1), ("b", "2024-01-02T00:00:00Z", 2), ("c", "2024-01-02", 3), ("d", "never", 4)], "id string, last_updated string, v int")
    t = spark.createDataFrame([("b", "2024-01-01", 0), ("c", "2024-01-02", 0), ("d", None, 0), ("e", "2024-01-01", 0)], "id string, last_updated string, v int")
    assert {r["id"]: r["action"] for r in sync.diff(s, t).collect()} == {"a": "add", "b": "update", "c": "unchanged", "d": "unchanged"}
    assert {r["id"]: r["action"] for r in sync.diff(s, t, deletes=True).collect()}["e"] == "delete"
    after = sync.apply_changes(s, t)
    assert {r["id"]: r["v"] for r in after.collect()} == {"a": 1, "b": 2, "c": 0, "d": 0, "e": 0}
    assert {r["action"] for r in sync.diff(s, after).collect()} == {"unchanged"}
    numbered = sync.batch_numbers(spark.range(0, 2500, 3), F.col("id"), F.expr("id div 100"), 7)
    assert sorted((r["id"], r["batch"]) for r in numbered.collect()) == [(x, k // 7) for k, x in enumerate(range(0, 2500, 3))]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("limit", [1024, 3])
def test_search(spark, metric, limit, monkeypatch):
    import palmleaf.operators.search as S

    monkeypatch.setattr(S, "BROADCAST_QUERIES", limit)
    x = np.round(np.random.default_rng(1).normal(size=(60, 5)), 2)
    x[7] = x[3]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(99, None)], "id long, embedding array<double>")
    got = {}
    for r in nearest(v, v.withColumnRenamed("id", "query_id"), 4, metric, skip_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    dot, n = x @ x.T, (x * x).sum(1)
    d = {"l2": n[:, None] + n - 2 * dot, "cosine": 1 - dot / np.sqrt(n[:, None] * n), "ip": 1 - dot}[metric].round(12)
    np.fill_diagonal(d, np.inf)
    assert got == {k: sorted(range(60), key=lambda j: (d[k, j], j))[:4] for k in range(60)}


def test_search_by_string_ids(spark):
    """Ids are any strings; ties go to the smaller one, and queries may have string ids too."""
    from palmleaf.plans import service

    rows = [("b", [0.0, 1.0], "x", {"k": "v"}), ("a", [0.0, 1.0], "y", None), ("é", [3.0, 0.0], "z", None), ("10", [0.0, 2.0], "w", None)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>, document string, metadata map<string,string>")
    asks = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<double>")
    got = service.search(vectors, asks, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["document"], r["distance"]) for r in got] == [("q", "a", "y", 0.0), ("q", "b", "x", 0.0), ("q", "10", "w", 1.0)]
    assert service.search(vectors.limit(0), asks, 3).count() == 0


def test_limits_of_injected_functions(spark):
    """A slow call is an error answer; misses are looked up at no more than the rate in all."""
    rows = spark.createDataFrame([("slow",), ("fast",)], "prompt string")

    def reply(x):
        if x == "slow":
            time.sleep(5)
        return f"said {x}"

    began = time.time()
    got = {r["prompt"]: r["answer"] for r in A.answered(rows, A.limited(reply, 1)).collect()}
    assert got["fast"] == "said fast" and "within 1 s" in got["slow"] and time.time() - began < 30
    cache = spark.createDataFrame([], "name string, meta map<string,string>")
    books = spark.createDataFrame([(f"book {k}",) for k in range(6)], "book string")
    stamps = [float(r["t"]) for r in enrich.enrich_misses(books, "book", cache, lambda n: {"STT": str(time.time())}, per_minute=120, workers=2).select(F.col("meta")["STT"].alias("t")).collect()]
    assert len(stamps) == 6 and max(stamps) - min(stamps) >= 1


def test_a_page_has_bounded_rows(spark):
    with pytest.raises(ValueError, match="too many"):
        report.html_table(spark.range(5), most=4)
    assert report.html_table(spark.range(3), most=4).count("<td>") == 3


def test_search_approximate(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(20)], "id long, embedding array<double>")
    got = nearest_approximate(v, v.withColumnRenamed("id", "query_id"), 2, within=1.5)
    assert {r["id"] for r in got.where("query_id = 5").collect()} <= {4, 5, 6}


def test_answers(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", {"Bộ": "x", "Việt Dịch": ""}), (1, 1, "a", {"Bộ": "x", "Việt Dịch": ""}), (1, 3, None, {}), (2, 1, " ", None)],
        "query_id long, rank int, document string, metadata map<string,string>",
    )
    assert {r["query_id"]: r["context"] for r in A.contexts(hits).collect()} == {1: "a\nb", 2: ""}
    assert {r["query_id"]: r["citations"] for r in A.citations(hits).collect()} == {1: ["Bộ: x"], 2: []}
    q = spark.createDataFrame([("q", "c"), ("q", " ")], "q string, c string").select(A.prompt(F.col("q"), F.col("c"))).collect()
    assert q[1][0] == "q" and q[0][0].startswith("Dựa vào") and q[0][0].endswith("'''\nc\n'''")
    said = spark.createDataFrame([(0, "ok"), (1, ""), (2, "x Tôi KHÔNG tìm thấy thông tin y"), (3, "boom")], "k int, prompt string")

    def model(p):
        if p == "boom":
            raise RuntimeError("down")
        return p

    got = {r["k"]: (r["answer"], r["kind"]) for r in A.answered(said, model).withColumn("kind", A.answer_kind(F.col("answer"))).collect()}
    assert got[0] == ("ok", "answer") and got[1] == got[2] == (A.P.NO_INFO, "no_info")
    assert got[3] == (A.P.ERROR_PREFIX + "down", "error")


def test_flag_report(spark):
    df = spark.createDataFrame([("<b>", "2025-05-20 16:21:55.588567"), (None, "2025-05-21 00:00:00"), ("x", "bad")], "t string, timestamp string")
    rows = report.flag_rows(df)
    assert [(r["t"], r["timestamp"]) for r in rows.collect()] == [(None, "2025-05-21 00:00:00"), ("<b>", "2025-05-20 16:21:55")]
    assert "<td>&lt;b&gt;</td>" in report.html_table(rows) and "<td><b></td>" in report.html_table(rows, escape=False)
    assert report.flag_rows(df.drop("timestamp")).count() == 3


def test_chunks_of_a_very_long_text(spark):
    df = spark.range(1).select(F.expr("repeat('Abc đef. ', 400000)").alias("text"))
    got = [r["content"] for r in chunk.chunk_rows(df).orderBy("chunk_no").collect()]
    assert " ".join(got) == ("Abc đef. " * 400000).strip() and {len(c) for c in got[:-1]} == {56 * 9 - 1}


def test_batch_numbers_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(sync, "BUCKETS", 3)
    rows = spark.range(-50, 150)
    got = {r["id"]: r["batch"] for r in sync.batch_numbers(rows, F.col("id"), F.floor(F.col("id") / 7), 9).collect()}
    assert got == {k: (k + 50) // 9 for k in range(-50, 150)}
