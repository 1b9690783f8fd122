"""Neighbours by balls, and the persistent approximate index, against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from palmleaf.operators import balls as B
from palmleaf.operators import search as S
from palmleaf.operators import vector_index as V


def clustered(n=1200, dims=16, seed=3):
    """Vectors around forty centres, some equal, a hot centre with a third of all."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dims)) * 10
    at = np.where(r.random(n) < 1 / 3, 0, r.integers(0, 40, n))
    x = np.round(centres[at] + r.normal(size=(n, dims)), 3)
    x[5] = x[9] = x[11]
    return x


def frame(spark, x, kind="array<double>"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(10_000, None)], f"id long, embedding {kind}")


def brute(x, k, metric, own=True):
    dot, n = x @ x.T, (x * x).sum(1)
    d = (n[:, None] + n - 2 * dot if metric == "l2" else 1 - dot / np.sqrt(np.maximum(n[:, None] * n, 1e-300))).round(12)
    if own:
        np.fill_diagonal(d, np.inf)
    return {q: sorted(range(len(x)), key=lambda j: (d[q, j], j))[:k] for q in range(len(x))}


def hits(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("own", [True, False])
def test_balls(spark, monkeypatch, metric, own):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "BLOCK_QUERIES", 50)
    x = np.round(clustered(400), 1)
    x[20] = x[21] = 0
    v = frame(spark, x)
    got = hits(S.nearest(v, v.withColumnRenamed("id", "query_id"), 4, metric, skip_self=own))
    want = brute(x, 4, metric, own)
    # equal distances may differ in their last digit by the way they are summed, so distances are compared, not ids
    assert set(got) == set(want) and all(len(g) == 4 for g in got.values())
    n = (x * x).sum(1)
    dist = lambda q, j: n[q] + n[j] - 2 * x[q] @ x[j] if metric == "l2" else 1 - x[q] @ x[j] / np.sqrt(max(n[q] * n[j], 1e-300))
    for q, ids in got.items():
        assert np.allclose([dist(q, j) for j in ids], [dist(q, j) for j in want[q]], atol=1e-9)


def test_balls_compute_few_pairs(spark):
    """On clustered vectors under a fifth of all pairs is computed, and every query meets what it has to."""
    x = clustered(2000)
    rows = frame(spark, x).where("embedding is not null")
    asks = rows.toDF("query_id", "q")
    ball, dealt = B.balls_of(rows, "l2")
    best = lambda qid, q, ids, y: S._best(qid, q, ids, y, 3, "l2", True)
    _, near, far = B.visits(dealt, asks, ball, best, "query_id long, id long, distance double", 3, True)
    assert ball.count.sum() == 2000 and B.pairs(near, ball) + B.pairs(far, ball) < 2000 * 2000 / 5


def test_balls_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 0)
    v = frame(spark, clustered(30))
    assert S.nearest(v.limit(0), v.withColumnRenamed("id", "query_id"), 3).count() == 0
    assert S.nearest(v, v.withColumnRenamed("id", "query_id").limit(0), 3).count() == 0
    # fewer rows than asked for: all of them
    assert {len(g) for g in hits(S.nearest(v.where("id < 3"), v.withColumnRenamed("id", "query_id"), 9)).values()} == {3}


def test_smallest():
    r = np.random.default_rng(1)
    d = r.integers(0, 6, (50, 90)).astype(float)
    d[3] = np.inf
    assert (S._smallest(d, 7) == np.argsort(d, axis=1, kind="stable")[:, :7]).all()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = frame(spark, clustered(1500), "array<float>")
    bad = spark.createDataFrame([(None, [1.0] * 16), (20_000, [float("nan")] * 16), (20_001, [None] + [1.0] * 15)], "id long, embedding array<float>")
    return v, V.VectorIndex.build(v.unionByName(bad), str(tmp_path_factory.mktemp("index")), cells=40, parts=4)


def test_index_holds_every_row(spark, index):
    v, built = index
    rows = built.lists().select("id", "code").collect()
    assert sorted(r["id"] for r in rows) == list(range(1500)) and {len(r["code"]) for r in rows} == {4}
    # opened anew it is the same
    again = V.VectorIndex(spark, built.path)
    assert np.array_equal(again.book.cells, built.book.cells) and np.array_equal(again.book.parts, built.book.parts)
    where = {r["id"]: r["cell"] for r in again.lists().collect()}
    near = again.book.nearest_cells(np.array([r["embedding"] for r in v.where("embedding is not null").orderBy("id").collect()]), 1)[:, 0]
    assert [where[k] for k in range(1500)] == near.tolist()


def test_index_recall(spark, index):
    v, built = index
    asks = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = S.nearest(v, asks, 5, skip_self=True)
    found = built.search(asks, 5, probes=6, skip_self=True)
    r = V.recall(found, exact).first()
    assert r["wanted"] == 75 * 5 and r["found"] >= 0.9 * r["wanted"]
    assert max(len(g) for g in hits(found).values()) == 5
    # distances are exact, and all cells with all candidates are the exact search
    full = built.search(asks, 5, probes=40, refine=400, skip_self=True)
    assert sorted((r["query_id"], r["id"], round(r["distance"], 4)) for r in full.collect()) == sorted((r["query_id"], r["id"], round(r["distance"], 4)) for r in exact.collect())


def test_index_prunes(spark, index):
    """A query that probes two cells reads two folders of lists."""
    v, built = index
    one = v.where("id = 7").withColumnRenamed("id", "query_id")
    cells = [r["cell"] for r in built.probed(one, 2).collect()]
    lists = built.lists().where(F.col("cell").isin(cells))
    assert len(cells) == 2 and {f.split("cell=")[1].split("/")[0] for f in lists.inputFiles()} >= {str(c) for c in cells}
    plan = lists.select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "embedding" not in plan
    found = built.search(one, 3, probes=2)
    assert {f"{r['id']}" for r in found.collect()} and "cell" in found._jdf.queryExecution().executedPlan().toString()


def test_index_grows(spark, index, tmp_path):
    v, _ = index
    built = V.VectorIndex.build(v.where("id < 700"), str(tmp_path / "i"), cells=20, parts=4)
    built.add(v.where("id >= 700"))
    assert built.lists().count() == 1500 and built.lists().select("id").distinct().count() == 1500
    hot = built.search(v.where("id = 900").withColumnRenamed("id", "query_id"), 1, probes=20).first()
    assert (hot["id"], hot["distance"]) == (900, 0.0)


def test_index_edges(spark, tmp_path):
    v = frame(spark, clustered(30), "array<float>")
    empty = V.VectorIndex.build(v.limit(0), str(tmp_path / "e"))
    asks = v.withColumnRenamed("id", "query_id")
    assert empty.search(asks).count() == 0
    small = V.VectorIndex.build(v.where("id < 3"), str(tmp_path / "s"))
    assert {len(g) for g in hits(small.search(asks, 5)).values()} == {3} and small.search(asks.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20, 1e6])
def test_best_is_exact(monkeypatch, metric, scale):
    """The screen in single precision loses nothing: far apart and nearly equal vectors, copies, zeros, vectors that aren't finite."""
    monkeypatch.setattr(S, "MOST_KEPT", 2000)
    r = np.random.default_rng(7)
    x = r.normal(size=(7000, 8))
    x[2000:3500] = x[2000] + r.normal(size=(1500, 8)) * 1e-9
    x[5000:5010] = 0 if metric != "cosine" else x[5000]
    x *= scale
    bad = np.full((3, 8), [[np.nan], [np.inf], [-np.inf]])
    q, ids = np.concatenate([x[1990:2020], x[4998:5012], bad]), r.permutation(7003) + 10
    x = np.concatenate([x, bad])
    got = S._best(np.r_[ids[1990:2020], ids[4998:5012], 1, 2, 3], q, ids, x, 6, metric, True)
    assert set(got["query_id"]) == set(ids[1990:2020]) | set(ids[4998:5012])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-150)
    for at in [*range(1990, 2020), *range(4998, 5012)]:
        a, b = (x[[at]], x[:7000]) if metric != "cosine" else (unit(x[[at]]), unit(x[:7000]))
        d = np.round(((a - b) ** 2).sum(1) if metric == "l2" else 1.0 - (a * b).sum(1), 12)
        d[at] = np.inf
        want = sorted(zip(d.tolist(), ids[:7000].tolist(), strict=True))[:6]
        mine = got[got["query_id"] == ids[at]]
        assert list(zip(mine["distance"], mine["id"], strict=True)) == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_vectors_without_clusters_meet_in_blocks(spark, monkeypatch, metric):
    """Where every ball is reached no query is copied once for each cell; blocks of both sides meet, copies of a vector don't crowd them."""
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(S, "FEW_ROWS", 50)
    monkeypatch.setattr(S, "nearest_by_balls", None)
    x = np.random.default_rng(5).normal(size=(600, 32)).astype(np.float32).astype(float)
    x[100:180] = x[100]
    v = frame(spark, x, "array<float>")
    got = hits(S.nearest(v, v.withColumnRenamed("id", "query_id"), 4, metric, skip_self=True))
    if metric == "ip":
        d = (1 - x @ x.T).round(12)
        np.fill_diagonal(d, np.inf)
        want = {q: sorted(range(600), key=lambda j: (d[q, j], j))[:4] for q in range(600)}
    else:
        want = brute(x, 4, metric)
        # all copies of a vector are equally far
        want |= {q: [j for j in range(100, 180) if j != q][:4] for q in range(100, 180)}
    assert got == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_a_block_stays_in_single_precision(metric):
    """A task holds its block's rows in the precision that they have, in order and as factors; in double precision only some at a time."""
    x = np.random.default_rng(6).normal(size=(100_000, 32)).astype(np.float32)
    ids = np.arange(len(x))[::-1].copy()
    tracemalloc.start()
    got = S._best(ids[:20], x[:20], ids, x, 3, metric, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * x.nbytes and len(got) == 60
    few = S._best(ids[:20], x[:20].astype(float), ids, x.astype(float), 3, metric, True)
    assert got.equals(few)


def test_copies_of_queries_come_some_at_a_time():
    part = B.pd.DataFrame({"query_id": range(10), "q": [[1.0]] * 10})
    i, c = np.nonzero(np.ones((10, 3000), bool))
    sizes = [len(p) for p in B._copies(part, i, c)]
    assert sum(sizes) == 30_000 and max(sizes) <= 4096


def test_refine_makes_up_for_codes(spark, tmp_path):
    """One part for 32 dimensions tells rows without clusters badly apart: so many candidates are ranked that the neighbours are among them."""
    x = np.random.default_rng(8).normal(size=(1500, 32))
    v = frame(spark, x).where("embedding is not null")
    built = V.VectorIndex.build(v, str(tmp_path / "r"), cells=4, parts=1)
    asks = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    exact = S.nearest(v, asks, 5, skip_self=True)
    share = lambda refine: (lambda r: r["found"] / r["wanted"])(V.recall(built.search(asks, 5, 4, refine, skip_self=True), exact).first())
    refine = built.refine_for(4, 0.95, sample=150)
    assert share(8) < 0.9 <= share(refine) and refine > 8


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_index_steps_hold_few_distances():
    """Rows and cells together set neither the memory of training nor that of naming cells and codes: all at once would be 82 MB and more here."""
    x = np.random.default_rng(9).normal(size=(20_000, 8))
    c, most = peak(lambda: V.centres(x, 512, rounds=2))
    assert c.shape == (512, 8) and most < 40 << 20
    book = V.Codebook(c, np.random.default_rng(10).normal(size=(4, V.CODES, 2)))
    (near, one), most = peak(lambda: (book.nearest_cells(x, 3), book.nearest_cells(x, 1)))
    assert most < 40 << 20
    d = ((x[:500, None] - c) ** 2).sum(2)
    assert (near[:500] == np.argsort(d, axis=1)[:, :3]).all() and (one[:, 0] == near[:, 0]).all()
    codes, most = peak(lambda: book.encode(x, one[:, 0]))
    assert codes.shape == (20_000, 4) and most < 40 << 20


def test_index_has_few_files(spark, index):
    """No more than there are cells and slots: a slot's share of rows is cut no further."""
    _, built = index
    assert len(built.lists().inputFiles()) <= 40 + int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("most", [3, 40, 2000])
def test_candidates_are_a_query_s_first(monkeypatch, most):
    """Cells are scanned one after another and few rows kept, equal codes by id, a query's own row left out: as if all were compared at once."""
    r = np.random.default_rng(12)
    book = V.Codebook(r.normal(size=(9, 6)) * 2, r.normal(size=(3, V.CODES, 2)))
    ids, cell = np.sort(r.permutation(5000)[:1500]), r.integers(0, 8, 1500)
    codes = r.integers(0, 256, (1500, 3)).astype(np.uint8)
    codes[200:320], cell[200:320] = codes[200], 3
    q = r.normal(size=(70, 6))
    asked = np.concatenate([ids[100:160], np.arange(9000, 9010)])
    near = book.nearest_cells(q, 5)
    monkeypatch.setattr(V, "TILE", 3000)
    monkeypatch.setattr(V, "DECODED", 50)
    monkeypatch.setattr(V, "MOST_KEPT", 500)
    i, j, d = V._candidates(book, ids, cell, codes, asked, q, np.repeat(np.arange(70), 5), near.ravel(), most, True)
    about = np.stack([book.decode(codes[[k]], cell[k])[0] for k in range(1500)])
    for a in range(70):
        mine = np.flatnonzero(np.isin(cell, near[a]) & (ids != asked[a]))
        far = ((q[a] - about[mine]) ** 2).sum(1).round(9)
        want = sorted(zip(far.tolist(), ids[mine].tolist(), strict=True))[:most]
        got = sorted(zip(d[i == a].round(9).tolist(), ids[j[i == a]].tolist(), strict=True))
        assert [x[1] for x in got] == [x[1] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want], atol=1e-8)


def test_queries_go_to_bundles_of_cells(spark, index, monkeypatch):
    """A query is sent to a bundle of cells once, not once for each cell; a cell of more rows than a bundle holds is cut."""
    v, built = index
    sizes = {r["cell"]: r["n"] for r in built.lists().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = v.where("id % 20 = 0 and embedding is not null").withColumnRenamed("id", "query_id")
    want = built.search(asks, 5, probes=30, refine=4, skip_self=True).collect()
    x = np.array([r["embedding"] for r in asks.orderBy("query_id").collect()])
    part = S.pd.DataFrame({"query_id": range(len(x)), "q": list(x)})
    near = built.book.nearest_cells(x, 30)
    asked = dict(zip(*(a.tolist() for a in np.unique(near, return_counts=True)), strict=True))
    first, blocks, loads = V._bundles(sizes, asked, 40, 30, 20)
    sent = V._sent(part, near, first, blocks, loads)
    bundles = int((first + blocks).max())
    assert bundles < 10 and len(sent) <= len(x) * bundles and not sent.duplicated(["query_id", "bundle"]).any()
    assert [set(np.concatenate(list(c)).tolist()) for _, c in sent.groupby("query_id")["cells"]] == [set(c) for c in near.tolist()]
    monkeypatch.setattr(V, "BLOCK_ROWS", 100)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 20)
    first, blocks, loads = V._bundles(sizes, asked, 40, 30, 20)
    assert blocks.max() >= 2 and loads.max() == 4 and all(blocks[c] * 100 >= n for c, n in sizes.items())
    key = lambda rows: sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in rows)
    assert key(built.search(asks, 5, probes=30, refine=4, skip_self=True).collect()) == key(want)
