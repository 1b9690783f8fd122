"""Running sums and carried values in stretches against a plain loop, and segmentation with stretches of four paragraphs."""

import random

import pytest
from pyspark.sql import functions as F

import palmleaf.operators.scan as SC
from palmleaf.operators import segment

import test_operators as cases


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(SC, "STRETCH", 4)
    monkeypatch.setattr(SC, "FANOUT", 3)


def test_scan(spark, small):
    r = random.Random(4)
    rows = []
    for key, n in (("a", 150), ("b", 1), (None, 30), ("c", 7)):
        places = sorted(r.sample(range(400), n))
        rows += [(key, p, r.choice([None, 1, 2]), r.choice([None, None, None, f"x{p}"]), "old") for p in places]
    df = spark.createDataFrame(rows, "k string, no int, n int, v string, total string").repartition(5)
    got = SC.scan(df, "k", "no", {"total": F.col("n"), "ones": F.lit(1)}, {"last": F.col("v"), "pair": F.when(F.col("v").isNotNull(), F.struct(F.col("n").alias("n")))})
    assert got.columns == ["k", "no", "n", "v", "total", "ones", "last", "pair"]
    want = []
    for key in ("a", "b", None, "c"):
        total, ones, last, pair = 0, 0, None, None
        for k, no, n, v, _ in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            total, ones, last, pair = total + (n or 0), ones + 1, v or last, (n,) if v else pair
            want.append((k, no, n, v, total, ones, last, pair))
    assert sorted(((*x[:7], tuple(x[7]) if x[7] else None) for x in got.collect()), key=str) == sorted(want, key=str)


def test_scan_without_rows(spark, small):
    df = spark.createDataFrame([], "k string, no int")
    assert SC.scan(df, "k", "no", {"n": F.lit(1)}).count() == 0


def test_segments_in_small_stretches(spark, small):
    cases.test_segments_v1_edge_cases(spark)
    cases.test_segments_v2_edge_cases(spark)


def long_book(seed=2, n=300):
    r = random.Random(seed)
    kinds = ["text", "text", "text", "text", "---o0o---", "PHẨM II: hai", "CHƯƠNG Một", "1. KINH x", "KINH y", "PHẦN 3", " "]
    return [x if (x := r.choice(kinds)) != "text" else f"line {k}" for k in range(n)]


@pytest.mark.parametrize("cut", [segment.segments_v1, segment.segments_v2])
def test_stretches_change_nothing(spark, monkeypatch, cut):
    """A book of three hundred paragraphs is cut in the same way whatever the stretches are."""
    df = cases.paragraphs(spark, {"one": long_book(), "two": long_book(5, 40)})
    rows = lambda: sorted(map(str, cut(df).collect()))
    whole = rows()
    monkeypatch.setattr(SC, "STRETCH", 4)
    monkeypatch.setattr(SC, "FANOUT", 3)
    assert rows() == whole and len(whole) > 20


def test_no_window_over_a_document(spark, small):
    for cut in (segment.running_v1, segment.running_v2):
        plan = cut(cases.paragraphs(spark, {"d": long_book(3, 20)}))._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window [" in x]
        assert windows and all("stretch" in x or "up#" in x for x in windows)
