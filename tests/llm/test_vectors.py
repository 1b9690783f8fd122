"""Top-k search and the metric range join against brute force."""

import math

import numpy as np
import pytest

import palmleaf.llm.range_join as RJ
import palmleaf.llm.topk_search as TK

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell string, rank string"


def vectors(seed=1, n=240, dims=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32)
    for k in range(0, n, 5):
        x[k] = x[(k * 7 + 3) % n] * r.uniform(0.5, 2) + r.normal(size=dims).astype(np.float32) * 0.08
    x[17] = x[40]
    x[18] = x[40] * 2
    x[60] = 0
    return [(k, v.tolist()) for k, v in enumerate(x)]


ODD = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (1020, None), (1004, []), (1005, [1.0, 0.5])]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 0, "old", "old", "old") for a, b in rows], SCHEMA)


def usable(rows):
    return [(k, v) for k, v in rows if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("block", [8192, 50])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(TK, "CANDIDATES", block)
    monkeypatch.setattr(TK, "QUERIES", 5)
    rows = vectors() + ODD
    good = usable(rows)
    ints = {k: [math.floor(64 * c) for c in v] for k, v in good}
    want = []
    for q, v in ints.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), k) for k, w in ints.items() if k != q)[:20]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert sorted(tuple(r) for r in TK.top_k(frame(spark, rows)).collect()) == sorted(want)
    walked = TK.walks(frame(spark, rows)).collect()
    assert sum(r["rows"] for r in walked) == len(good) * len({q for q in ints if q % 20 == 0}) and all(r["seen"] <= r["rows"] for r in walked)


@pytest.mark.parametrize("size", [1e6, 1e9, 1e300, 2e307])
def test_top_k_of_large_components(spark, size):
    """Scores above 2**53 are exact integers; those that a long can't hold are its ends, ties to the smaller id."""
    r = np.random.default_rng(2)
    rows = [(k, [float(v) for v in np.round(r.normal(size=5), 3) * size + r.integers(0, 9, 5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {k: [math.floor(64 * c) if abs(c) < 2**53 else 64 * int(c) for c in v] for k, v in rows}
    clip = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q in (0, 20, 40):
        scored = sorted((-clip(sum(a * b for a, b in zip(ints[q], w, strict=True))), k) for k, w in ints.items() if k != q)[:20]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert sorted(tuple(r) for r in TK.top_k(df).collect()) == want
    assert all(r["seen"] <= r["rows"] for r in TK.walks(df).collect())


def test_threshold_stops_early():
    rows = np.zeros((4096, 3))
    rows[:, 0] = np.arange(4096)
    ((ids, scores),), walks = TK.threshold_search(rows, np.arange(4096), np.array([[2.0, 0, -1]]), np.array([-1]), 3)
    assert ids.tolist() == [4095, 4094, 4093] and scores.tolist() == [8190, 8188, 8186]
    assert walks[0, 2] == 1 and walks[0, 0] < 100


def best(rows, ids, query, own, k):
    return sorted((-float(r @ query), int(i)) for r, i in zip(rows, ids, strict=True) if i != own)[:k]


@pytest.mark.parametrize(("decay", "share"), [(0.6, 0.3), (1.0, 1.0)])
def test_threshold_walk(decay, share):
    """Where few directions carry the vectors, turned as they may be, the bound ends every walk after a share of the rows; always the result is exact."""
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.normal(size=(24, 24)))[0]
    rows = np.floor(64 * (r.normal(size=(4000, 24)) * decay ** np.arange(24)) @ turn)
    ids = r.permutation(4000)
    queries = rows[:40]
    got, walks = TK.threshold_search(rows, ids, queries, ids[:40], 10)
    for q, (who, scores) in enumerate(got):
        assert list(zip((-scores).tolist(), who.tolist(), strict=True)) == best(rows, ids, queries[q], ids[q], 10)
    assert walks[:, 0].mean() <= share * 4000
    assert decay == 1 or walks[:, 2].all()


def test_unseen_bound():
    r = np.random.default_rng(6)
    for _ in range(200):
        weight, edge, norm = np.abs(r.normal(size=(1, 5))), r.normal(size=(1, 5)), r.uniform(0.1, 3)
        x = np.minimum(r.normal(size=(4000, 5)), edge)
        x = x[np.sqrt((x * x).sum(1)) <= norm]
        assert not len(x) or (x @ weight[0]).max() <= TK.unseen_bound(weight, edge, norm)[0] + 1e-9


def test_top_k_ties_and_edges(spark):
    same = [(k, [1.0, 0.0]) for k in range(45)] + [(None, [1.0, 0.0])]
    got = TK.top_k(frame(spark, same)).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))
    assert TK.top_k(frame(spark, [])).count() == 0
    assert TK.top_k(frame(spark, [(0, [1.0])])).count() == 0
    assert TK.top_k(frame(spark, [(0, [1.0]), (0, [1.0]), (1, [1.0])])).count() == 2


@pytest.mark.parametrize(("cell", "block"), [(8192, 16384), (20, 16384), (9, 7)])
def test_range_join(spark, monkeypatch, cell, block):
    monkeypatch.setattr(RJ, "CELL_ROWS", cell)
    monkeypatch.setattr(RJ, "BLOCK_ROWS", block)
    rows = vectors(3) + ODD
    good = [(k, v) for k, v in usable(rows) if any(v)]
    wide = np.zeros((len(good), 6))
    for x, (_, v) in zip(wide, good, strict=True):
        x[: len(v)] = v
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array([k for k, _ in good])
    for _ in range(len(good)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(good))])
    want = {k: (0, k, True) for k, _ in rows}
    want |= {k: (int(near[i].sum()), int(label[i]), int(label[i]) == k) for i, (k, _) in enumerate(good)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in RJ.near_vectors(frame(spark, rows)).collect()}
    assert got == want and near.sum() > 50


def test_range_join_edges(spark):
    assert RJ.near_vectors(frame(spark, [])).count() == 0
    got = RJ.near_vectors(frame(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"]) == [(5, 2, 5), (5, 2, 5), (7, 2, 5)]
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)]
