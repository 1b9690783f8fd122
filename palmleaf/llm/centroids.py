"""Centroid clustering of integer vectors: float32 screening with rounding-error intervals, exact integers where intervals overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .topk_search import usable

#: Components up to this are exact in single precision, and their squared distances in 64 bits; larger ones take Python's integers.
EXACT = 1 << 24
#: Rows of one matrix product.
BLOCK_ROWS = 4096
_LIMB = 40
_LONGEST = (1 << 63) - 1


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles that hold integers; `vectors` is an Arrow list column without nulls."""
    return np.floor(np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), dims) * scale)


def exact_distances(x: np.ndarray, c: list[list[int]], i: np.ndarray, j: np.ndarray) -> list[int]:
    """Squared distances of the pairs (row i of x, centroid j), in Python's integers of any size."""
    return [sum((int(a) - b) ** 2 for a, b in zip(x[p], c[q], strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)]


def assign(x: np.ndarray, c: list[list[int]]) -> tuple[np.ndarray, list[int | np.integer], int]:
    """The nearest centroid of each row (ties: the smaller number), the exact squared distance, and how many rows screening left open.

    A product in single precision gives every distance with an interval. With u = 2**-24, n components and any order of
    summation, the product's error is at most n*u / (1 - n*u) * |x| * |c|; the doubles around it add a few units of 2**-53.
    A centroid is out where its interval starts behind the end of another one's. A row with one centroid left is decided; the
    others' remaining pairs are worked out in integers. A row or centroid with a component above EXACT isn't screened by
    products: such a centroid is out only where one component alone puts it behind, such a row is compared exactly with all.
    """
    n, dims = x.shape
    size = np.abs(x).max(1, initial=0)
    most = np.array([max(map(abs, row), default=0) for row in c], np.float64)
    small_rows, small = np.flatnonzero(size <= EXACT), np.flatnonzero(most <= EXACT)
    large_rows, large = np.flatnonzero(size > EXACT), np.flatnonzero(most > EXACT)
    cluster, distance, opened = np.zeros(n, np.int64), [0] * n, len(large_rows)
    cs = np.array([c[k] for k in small], np.int64).reshape(len(small), dims)
    cc, c32 = (cs * cs).sum(1), cs.astype(np.float32).T.copy()
    u = dims * 2.0**-24
    gamma = u / (1 - u)
    for s in range(0, len(small_rows), BLOCK_ROWS):
        rows = small_rows[s : s + BLOCK_ROWS]
        xi = x[rows].astype(np.int64)
        xx = (xi * xi).sum(1)
        length = np.sqrt(xx.astype(np.float64))[:, None] * np.sqrt(cc.astype(np.float64))[None, :] * (1 + 1e-12)
        total = xx[:, None].astype(np.float64) + cc[None, :]
        near = total - 2 * (xi.astype(np.float32) @ c32).astype(np.float64)
        reach = 2 * gamma * length + 2.0**-50 * (total + 2 * length)
        low, high = np.full((len(rows), len(c)), 0.0), np.full((len(rows), len(c)), np.inf)
        low[:, small], high[:, small] = near - reach, near + reach
        low[:, large] = np.maximum(most[large][None, :] - size[rows][:, None], 0) ** 2 * (1 - 1e-12)
        left = low <= high.min(1)[:, None]
        count = left.sum(1)
        best = left.argmax(1)
        open_rows = np.flatnonzero(count > 1)
        opened += len(open_rows)
        if len(open_rows):
            i, j = np.nonzero(left[open_rows])
            i = open_rows[i]
            if len(large):
                d = np.array(exact_distances(xi, c, i, j), object)
            else:
                d = ((xi[i] - cs[j]) ** 2).sum(1)
            order = np.lexsort((j, d, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            best[i[first]] = j[first]
        cluster[rows] = best
        at = np.searchsorted(small, best)
        plain = most[best] <= EXACT
        got = np.zeros(len(rows), object)
        got[plain] = ((xi[plain] - cs[at[plain]]) ** 2).sum(1)
        if not plain.all():
            k = np.flatnonzero(~plain)
            got[k] = exact_distances(xi, c, k, best[k])
        for r, d in zip(rows.tolist(), got.tolist(), strict=True):
            distance[r] = d
    for r in large_rows.tolist():
        d = exact_distances(x, c, np.full(len(c), r), np.arange(len(c)))
        cluster[r] = k = min(range(len(c)), key=lambda k: (d[k], k))
        distance[r] = d[k]
    return cluster, distance, opened


def _sums(x: np.ndarray, cluster: np.ndarray, total: dict[int, list]) -> None:
    """Add to `total` (cluster: [count, sums]) the rows of x; sums are Python's integers."""
    order = np.argsort(cluster, kind="stable")
    starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = x[order[a:b]]
        k = int(cluster[order[a]])
        got = rows.astype(np.int64).sum(0).tolist() if np.abs(rows).max() <= EXACT else [sum(map(int, col)) for col in rows.T.tolist()]
        if k in total:
            total[k] = [total[k][0] + len(rows), [p + q for p, q in zip(total[k][1], got, strict=True)]]
        else:
            total[k] = [len(rows), got]


def kept(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """The rows whose embedding has exactly `dims` components, all finite numbers."""
    return vectors.where(F.coalesce((F.size("embedding") == dims) & usable("embedding"), F.lit(False)))


def starts(points: DataFrame, k: int, dims: int, scale: int, salt: str) -> list[list[int]]:
    """The integer vectors of the k rows with the smallest sha256 of `salt`:vec_id; null ids come last, equal ids by their components."""
    lot = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    got = points.select(lot.alias("lot"), "embedding").orderBy(F.asc_nulls_last("lot"), "embedding").limit(k).collect()
    return [[int(v) for v in np.floor(np.asarray(r["embedding"], np.float64) * scale)] for r in got]


def fit(points: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> list[list[int]]:
    """Centroids after `rounds` rounds over the rows of `kept`: every vector goes to its nearest centroid, then every centroid with
    vectors becomes the exact floor of their mean. Fewer than k rows give fewer centroids.

    A task adds up its own rows and sends one row a centroid and component, as limbs of 40 bits whose sums Spark adds as
    longs; so sums of any size are exact, and the driver gets k * dims rows a round, however many tasks there are.
    """
    c = starts(points, k, dims, scale, salt)
    limbs = [f"l{i}" for i in range(5)]
    for _ in range(rounds if c else 0):
        shared = points.sparkSession.sparkContext.broadcast(c)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                if batch.num_rows:
                    x = whole_numbers(batch.column(0), dims, scale)
                    _sums(x, assign(x, shared.value)[0], total)
            rows = [
                (k, d, n, *[(v >> _LIMB * i) & ((1 << _LIMB) - 1) for i in range(4)], v >> _LIMB * 4)
                for k, (n, sums) in total.items() for d, v in enumerate(sums)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in zip(*rows, strict=True)], names=["cluster", "dim", "n", *limbs])

        parts = points.select("embedding").mapInArrow(add, "cluster long, dim long, n long, " + ", ".join(f"{x} long" for x in limbs))
        new: dict[int, dict[int, int]] = {}
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in limbs]).collect():
            new.setdefault(r["cluster"], {})[r["dim"]] = sum(r[x] << _LIMB * i for i, x in enumerate(limbs)) // r["n"]
        shared.unpersist()
        c = [[new[k][d] for d in range(dims)] if k in new else row for k, row in enumerate(c)]
    return c


def assign_all(points: DataFrame, c: list[list[int]], dims: int = 64, scale: int = 256, cluster_col: str = "cluster", distance_col: str = "distance") -> DataFrame:
    """Add the nearest centroid and the squared distance to rows of `kept`; a distance that a long can't hold is null. Columns named
    like the new ones are replaced, others pass."""
    points = points.drop(cluster_col, distance_col)
    shared = points.sparkSession.sparkContext.broadcast(c)

    def near(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in columns:
            cluster, distance, _ = assign(whole_numbers(vectors, dims, scale), shared.value)
            far = [int(d) if d <= _LONGEST else None for d in distance]
            yield pa.StructArray.from_arrays([pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["c", "d"])

    name = fresh(points, "near")
    return points.withColumn(name, F.arrow_udf(near, "c int, d long")(F.col("embedding"))).select(
        *[F.col(f"`{x}`") for x in points.columns], F.col(f"{name}.c").alias(cluster_col), F.col(f"{name}.d").alias(distance_col)
    )


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row (vec_id, embedding) that takes part.

    Rows take part whose embedding has `dims` finite components; they become integers floor(scale * x) first. Null and repeated
    ids are rows like others. Sums and distances are exact integers; one that a long can't hold is null. An empty table, or one
    without such a row, gives no rows.
    """
    points = kept(vectors.select("vec_id", "embedding"), dims)
    c = fit(points, k, rounds, dims, scale, salt)
    told = materialize(assign_all(points, c or [[0] * dims], dims, scale).drop("embedding"))
    # one row a centroid
    sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("told")).collect()
    each = {r["cluster"]: int(r["sum"]) if r["n"] == r["told"] and r["sum"] <= _LONGEST else None for r in sums}
    whole = None if None in each.values() or sum(each.values()) > _LONGEST else sum(each.values())
    print_of = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    rows = [(x, inertia, whole, print_of[x]) for x, inertia in each.items()]
    table = told.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
