"""Normalisation and patterns against Python's own functions."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from palmleaf.functions import patterns as P
from palmleaf.functions import text as T

TEXTS = ["", " ", "Đế đỗ", "é à", " x y　", "ÀÉ_b-c d", "Straße œuvre Ærø", "a/b:c*?", None, "日本 abc", "\x1cq\x1f"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "k int, x string")


def values(df, col):
    return [r[0] for r in df.orderBy("k").select(col).collect()]


def test_nfc_and_nfd(rows):
    x = F.col("x")
    assert values(rows, T.nfc(x)) == [t if t is None else unicodedata.normalize("NFC", t) for t in TEXTS]
    assert values(rows, T.nfd(x)) == [t if t is None else unicodedata.normalize("NFD", t) for t in TEXTS]


def test_normal_forms_of_all_characters():
    """A text without suspect characters is in its form; every character that a form changes is suspect."""
    r = random.Random(3)
    for form in ("NFC", "NFD"):
        odd = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", T.suspects(form))).match
        every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
        fine = [c for c in every if not odd(c)]
        assert all(unicodedata.is_normalized(form, c) for c in fine) and len(fine) > 1_000_000
        letters = [c for c in fine if c.isalpha()]
        for _ in range(3000):
            assert unicodedata.is_normalized(form, "".join(r.choices(letters, k=40)))


def test_only_suspects_leave_the_jvm(spark):
    """What Python gets is null for every text that is in normal form, or plain."""
    df = spark.createDataFrame([(0, "plain"), (1, "Đế đỗ"), (2, "e\u0301"), (3, None), (4, "ế")], "k int, x string")
    for got, sent in ((T.nfc("x"), [False, False, True, None, False]), (T.nfd("x"), [False, True, True, None, True])):
        assert values(df, F.col("x").rlike(T.suspects("NFC" if sent[1] is False else "NFD"))) == sent
        plan = df.select(got)._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in next(x for x in plan.split("\n") if "ArrowEvalPython" in x or "put(" in x)


def test_keys_of_other_scripts(spark):
    titles = ["Αγάπη", "Ψυχή", "Философия", "Щука и ёж", "Thiền sư Đạo", "אהבה", "สวัสดี", "かな カナ", "한국", "नमस्ते", "٣٤ كتاب", "Ærø"]
    df = spark.createDataFrame(list(enumerate(titles)), "k int, x string")
    got = values(df, T.match_key_a(F.col("x")))
    assert len(set(got)) == len(titles) and all(re.fullmatch("[a-z0-9]+", k) for k in got)
    assert got[0] == "agape" and got[2] == "filosofiya" and got[4] == "thiensudao" and got[7] == "kanakana" and got[11] == "aero", got
    assert got[1].startswith("ps") and got[3].startswith("shchuka") and got[8].startswith("h") and got[10].startswith("34")


def test_strip_is_pythons(rows):
    assert values(rows, T.strip(F.col("x"))) == [t if t is None else t.strip() for t in TEXTS]


def test_match_keys_disagree_on_d(rows):
    a, b = values(rows, T.match_key_a(F.col("x"))), values(rows, T.match_key_b(F.col("x")))
    assert (a[2], b[2]) == ("dedo", "đeđo")
    assert (a[8], b[8]) == ("", "none")
    assert a[6] == "strasseoeuvreaero" and a[5] == "aebcd" == b[5]
    assert a[9] == "abc" and b[9] == "日本abc"


def test_names(spark):
    df = spark.createDataFrame([(0, "a/b:c", 3, 12)], "k int, t string, c int, n int")
    t, c, n = F.col("t"), F.col("c"), F.col("n")
    assert values(df, T.segment_name_v1(F.lit("b"), c, n, t)) == ["b_pham_03_kinh_012_a_b_c.json"]
    assert values(df, T.segment_name_v2(F.lit("b k"), c, F.lit("s"), n, F.lit("t"))) == ["b_k_pham_03_s_kinh_012_t.json"]
    assert values(df, T.segment_name_v2(F.lit("b"), c - 3, F.lit("s"), n, F.lit(""))) == ["b_kinh_012.json"]
    assert values(df, T.base_name(F.lit("x/y z-1.docx"), hyphens=True)) == ["y_z_1"]
    assert values(df, T.known_name(F.lit("q"), {"q": "r"})) == ["r"]


def test_headings(spark):
    cases = ["PHẨM một", "3. phẩm hai", "PHẦN 4", "PHẦN bốn", "12. KINH x", "KINH x", "1234. KINH x", "---o0o---", " - - - o0o - - - ", "o0o"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    x = F.col("x")
    assert values(df, P.is_chapter_v1(x)) == [True, True, True, False, False, False, False, False, False, False]
    assert values(df, P.is_sutra_v1(x)) == [False, False, False, False, True, False, False, False, False, False]
    assert values(df, P.is_delimiter_v1(x)) == [False] * 7 + [True, True, True]
    assert values(df, P.is_chapter_v2(x))[:4] == [True, False, True, True]
    assert values(df, P.is_sutra_v2(x))[4:7] == [True, True, True]


def test_chapter_numbers(spark):
    cases = [("iv", 4), ("MCMXC", 1990), ("12", 12), ("Nhất", None), ("", None)]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string")
    assert values(df, P.chapter_number(F.col("x"))) == [v for _, v in cases]
    titles = spark.createDataFrame([(0, "phẩm thứ II: Duyên khởi"), (1, "CHƯƠNG 5")], "k int, x string")
    assert values(titles, P.chapter_title_v2(F.col("x"))) == ["PHẨM II: Duyên khởi", "CHƯƠNG 5"]


def test_sentences_match_python(spark):
    texts = ["A b. C d! Đ e? f g. \"H\" i. 1 j. K", "x. Y", "no end", "A.B. C"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    assert values(df, P.sentences(F.col("x"))) == [re.split(r"(?<=[.!?])\s+(?=[A-ZĐ])", t) for t in texts]


def test_few_values_are_python_s_at_once(spark):
    """A batch stays Arrow's: no more than ROWS of its values are Python's; nulls stay null, or are handed over if asked."""
    import pyarrow as pa

    live, seen = [], []

    class Slices:
        """An array that notes how many values are taken from it at once."""

        def __init__(self, x):
            self.x, self.null_count = x, x.null_count

        def __len__(self):
            return len(self.x)

        def __getitem__(self, s):
            live.append(len(self.x[s]))
            return self.x[s]

    texts = [None if k % 7 == 0 else f"é{k}" for k in range(1000)]
    run = T.row_by_row(lambda s: seen.append(s) or s.upper(), "string", pa.string()).func
    got = list(run(iter([Slices(pa.array(texts)), pa.array([], pa.string()), pa.array([None], pa.string())])))
    assert [x for y in got for x in y.to_pylist()] == [None if t is None else t.upper() for t in texts] + [None]
    assert max(live) <= T.ROWS and None not in seen
    told = T.row_by_row(lambda s: f"<{s}>", "string", pa.string(), nulls=True)
    assert [r[0] for r in spark.createDataFrame([("a",), (None,)], "t string").select(told(F.col("t"))).collect()] == ["<a>", "<None>"]
