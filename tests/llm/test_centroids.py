"""Centroid clustering against Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from palmleaf.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, near string, distance string"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((dist(v, w), j) for j, w in enumerate(c))[::-1]
    for _ in range(rounds):
        at = [near(v)[0] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c[j] for j, g in enumerate(groups)]
    told = [(i, *near(v)) for i, v in kept]
    fit = lambda n: n if n is not None and n < 1 << 63 else None
    each = {j: sum(d for _, a, d in told if a == j) for j in range(len(c))}
    small = {j: all(fit(d) is not None for _, a, d in told if a == j) and fit(each[j]) is not None for j in each}
    whole = fit(sum(each.values())) if all(small.values()) else None
    names = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, fit(d), each[j] if small[j] else None, whole, names[j]) for i, j, d in told), key=str)


def vectors(n=150, dims=64, seed=2):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, dims)), 1)
    x[::9] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [math.nan] * dims), (905, [math.inf] * dims), (None, rows[4][1]), (5, rows[6][1]), (5, rows[5][1])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "old", "old", "old") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("more", [[], [(7000, [1e30] + [0.5] * 63), (7001, [-3e38] * 64), (7002, [2.0**19 + k for k in range(64)])]])
def test_clusters(spark, more):
    rows = vectors() + more
    got = sorted((tuple(r) for r in centroids.clusters(frame(spark, rows).repartition(5)).collect()), key=str)
    assert got == plain(rows, 40, 5, 64)


def test_few_and_none(spark):
    rows = vectors(12)
    assert sorted((tuple(r) for r in centroids.clusters(frame(spark, rows)).collect()), key=str) == plain(rows, 40, 5, 64)
    assert centroids.clusters(frame(spark, [])).count() == 0
    assert centroids.clusters(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    told = centroids.assign_all(centroids.kept(frame(spark, rows)), [[0] * 64])
    assert told.columns == ["vec_id", "embedding", "near", "cluster", "distance"] and {r["near"] for r in told.collect()} == {"old"}


@pytest.mark.parametrize("span", [3, 300, 1 << 20, 1 << 24, 1 << 40])
def test_assign(span):
    """Equal to exact search in every range, ties to the smaller number; where distances differ widely, screening decides most rows."""
    r = np.random.default_rng(span)
    x = np.floor(r.uniform(-span, span, (500, 16)))
    c = [[int(v) for v in row] for row in np.floor(r.uniform(-span, span, (30, 16)))]
    c[20] = c[4]
    c[9] = [v + (k == 0) for k, v in enumerate(c[4])]
    cluster, distance, opened = centroids.assign(x, c)
    for row, j, d in zip(x.tolist(), cluster.tolist(), distance, strict=True):
        assert (int(d), j) == min((sum((int(a) - b) ** 2 for a, b in zip(row, w, strict=True)), k) for k, w in enumerate(c))
    assert span > 1 << 24 or opened < 200


def test_intervals_are_needed():
    """Single precision alone would choose wrongly: two centroids that differ by one unit far from the origin."""
    far = float(1 << 23)
    x = np.full((40, 64), far) + np.arange(40)[:, None] % 2
    c = [[int(far) + 1] * 63 + [int(far)], [int(far)] * 64, [int(far)] * 63 + [int(far) + 1], [0] * 64]
    cluster, distance, opened = centroids.assign(x, c)
    assert opened == 40 and cluster.tolist() == [1, 0] * 20 and [int(d) for d in distance] == [0, 1] * 20
