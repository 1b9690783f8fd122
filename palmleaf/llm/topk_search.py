"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists, in blocks of candidates and queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries: what one task holds.
CANDIDATES, QUERIES = 8192, 1024
#: List entries for each dimension that a walk's first round reads.
ROUND = 8
SCHEMA, WALKS = "query_id long, vec_id long, score long", "query_id long, rows long, seen long, entries long, by_bound long"


def usable(vector: str):
    """Whether a vector takes part: not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def rotation(rows: np.ndarray) -> np.ndarray:
    """The principal axes of the rows, as columns: an orthogonal matrix, so inner products stay what they are."""
    most = np.abs(rows).max(initial=0) or 1.0
    return np.linalg.eigh((rows / most).T @ (rows / most))[1]


def unseen_bound(weight: np.ndarray, edge: np.ndarray, norm: float) -> np.ndarray:
    """For each row of `weight` (none below 0) the most that weight * x can be where x <= edge in each place and |x| <= norm.

    The optimum is x = min(edge, t * weight) for the t at which |x| is the norm; it is approached from above, so the bound holds.
    Where even the edges below 0 are longer than the norm, no row is left: -inf.
    """
    box = np.minimum(edge, 0)
    reach = np.maximum(edge, 0)
    low, high = np.zeros(len(weight)), np.full(len(weight), 1.0)
    length = lambda t: np.sqrt((np.where(edge < 0, box, np.minimum(reach, t[:, None] * weight)) ** 2).sum(1))
    free = np.sqrt((np.where(weight > 0, edge, box) ** 2).sum(1)) <= norm
    for _ in range(60):
        short = ~free & (length(high) < norm)
        if not short.any():
            break
        high[short] *= 4
    for _ in range(40):
        mid = (low + high) / 2
        over = length(mid) >= norm
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    best = np.where(free[:, None], edge, np.where(edge < 0, box, np.minimum(reach, high[:, None] * weight)))
    return np.where(np.sqrt((box**2).sum(1)) > norm * (1 + 1e-9), -np.inf, (best * weight).sum(1))


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query the ids and scores of its k best rows, by inner product, then smaller id; and how each walk went: rows
    seen, list entries read, and 1 where the bound ended it (0: every row had been seen).

    Rows and queries are turned to the rows' principal axes, where few lists carry most of a score, and every axis's list of
    rows is sorted once. A query walks the lists from the end that its sign favours, in rounds that each read four
    times the entries, and deals these out by what a list can add: its weight times its spread. Each row seen is scored in full, by the
    numbers as they came. A row not seen yet is behind every list's last entry and no longer than the longest row, which
    bounds its score; the walk ends when the kth score exceeds that bound.
    """
    m, dims = rows.shape
    axes = rotation(rows)
    turned, weights = rows @ axes, queries @ axes
    order = np.ascontiguousarray(np.argsort(turned, axis=0, kind="stable").T)
    place = np.empty((dims, m), np.int16 if m < 1 << 15 else np.int64)  # of each row in each list
    np.put_along_axis(place, order, np.arange(m, dtype=place.dtype)[None, :], 1)
    values = np.take_along_axis(turned.T, order, 1)
    norm = float(np.sqrt((rows * rows).sum(1)).max(initial=0)) * (1 + 1e-9)
    up, weight = weights > 0, np.abs(weights)
    # the share of each list in the entries that a round reads; lists that can add nothing are left alone
    share = weight * turned.std(0) + 1e-300
    share /= share.sum(1, keepdims=True)
    budgets = [ROUND * dims << 2 * j for j in range(20) if j == 0 or ROUND * dims << 2 * (j - 1) < 2 * m * dims]
    depths = [np.minimum(np.ceil(b * share).astype(np.int64), m) for b in budgets]
    slack = 1e-9 * (weight @ np.abs(values).max(1, initial=0))
    lists = np.arange(dims)
    bounds = []
    for d in depths:
        at = np.where(up, m - d, d - 1)
        bounds.append(unseen_bound(weight, np.where(up, values[lists, at], -values[lists, at]), norm) + slack)
    exact = rows.astype(np.float32) if dims and dims * max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) ** 2 < 1 << 24 else rows
    out, walks = [], np.zeros((len(queries), 3), np.int64)
    mark, some = np.zeros(m, bool), np.zeros(m, bool)
    for q in range(len(queries)):
        ask = queries[q].astype(exact.dtype)
        seen = np.zeros(m, bool)
        found, scores = np.empty(0, np.int64), np.empty(0)
        before = np.zeros(dims, np.int64)
        for depth, bound in zip(depths, bounds, strict=True):
            now = depth[q]
            read = int((now - before).sum())
            walks[q, 1] += read
            mark[:] = False
            steps = zip(before.tolist(), now.tolist(), up[q].tolist(), strict=True)
            if read < m:  # few entries: their rows one by one
                for i, (a, b, f) in enumerate(steps):
                    mark[order[i, m - b : m - a] if f else order[i, a:b]] = True
            else:  # many: the rows whose places in a list it has read
                for i, (a, b, f) in enumerate(steps):
                    if b > a:
                        mark |= np.greater_equal(place[i], m - b, out=some) if f else np.less(place[i], b, out=some)
            before = now
            mark &= ~seen
            seen |= mark
            new = np.flatnonzero(mark)
            # many rows are read in order and then picked, few one by one
            got = (exact @ ask)[new] if 4 * len(new) > m else exact[new] @ ask
            if len(scores) == k:
                high = got >= scores[-1]
                new, got = new[high], got[high]
            other = ids[new] != own[q]
            new, got = new[other], got[other].astype(np.float64)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, got])
            if len(found) > 4 * k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= least], scores[scores >= least]
            best = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k and scores[-1] > bound[q]:
                walks[q, 2] = 1
                break
            if seen.all():
                break
        walks[q, 0] = np.count_nonzero(seen)
        out.append((ids[found], scores))
    return out, walks


def integer_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids and scores of each query's k best rows where doubles can't hold the scores: floor(scale * component) of all rows in
    Python's integers. A score that a long can't hold counts as the long nearest to it."""
    # beyond 2**53 a double is an integer
    down = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(scale * v)
    whole = np.array([[down(v) for v in row] for row in rows.tolist()], object).reshape(rows.shape)
    out = []
    for query, me in zip(queries.tolist(), own.tolist(), strict=True):
        scores = whole @ np.array([down(v) for v in query], object)
        ranked = sorted((-min(max(int(s), -(1 << 63)), (1 << 63) - 1), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != me)[:k]
        out.append((np.array([i for _, i in ranked], np.int64), np.array([-s for s, _ in ranked], np.int64)))
    return out


def _blocks(vectors: DataFrame, k: int, every: int, scale: int, walked: bool) -> DataFrame:
    """Each block of queries against each block of candidates: the k best of each query, or how its walk went."""
    part = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    # under names of their own: the two sides of a cogroup must not share attributes, or Spark prunes those of one
    asks = part.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    size = part.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    blocks, groups = max(1, -(-size["n"] // CANDIDATES)), max(1, -(-size["q"] // QUERIES))
    slot = lambda n, c: F.pmod(F.xxhash64(c, F.lit("slot")), F.lit(n))
    rows = part.withColumn("block", slot(blocks, "vec_id")).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asks = asks.withColumn("ask", slot(groups, "query_id")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = WALKS if walked else SCHEMA

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        width = max(left["embedding"].map(len).max(), right["query"].map(len).max(), 1)
        a, b = matrix(left["embedding"], width), matrix(right["query"], width)
        own, most = right["query_id"].to_numpy(), [scale * float(np.abs(x).max()) + 1 for x in (a, b)]
        if width * most[0] * most[1] >= 2.0**53:
            got, walks = integer_search(a, left["vec_id"].to_numpy(), b, own, k, scale), np.tile([len(a), 0, 0], (len(own), 1))
        else:
            got, walks = threshold_search(np.floor(scale * a), left["vec_id"].to_numpy(), np.floor(scale * b), own, k)
        if walked:
            return pd.DataFrame(np.column_stack([own, np.full(len(own), len(a)), walks]), columns=names)
        return pd.DataFrame(
            {
                "query_id": np.repeat(own, [len(x) for x, _ in got]),
                "vec_id": np.concatenate([x for x, _ in got]),
                "score": np.concatenate([s for _, s in got]).astype(np.int64),
            }
        )

    return rows.groupBy("block", "ask").cogroup(asks.groupBy("block", "ask")).applyInPandas(search, schema)


def walks(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rows, seen, entries, by_bound: how `top_k` walks, a row for each query and block of candidates."""
    return _blocks(vectors, k, every, scale, True)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of (vec_id, embedding) with the largest integer inner product for each query.

    Components become floor(scale * x). Queries are the rows whose vec_id `every` divides; candidates are all rows but
    those of the query's own vec_id. Ties go to the smaller vec_id; fewer candidates give fewer ranks. Rows with a null
    id, a null vector or components that are null or not finite take no part; a shorter vector counts as ended by zeros;
    repeated rows count each. Scores are exact; a block in which they may reach 2**53 is worked out in integers of any size, and a
    score that a long can't hold counts as the long nearest to it. Each block of queries meets each block of
    candidates in a task of bounded size; the blocks' best are merged by a window that keeps k rows before the shuffle.
    """
    best = _blocks(vectors, k, every, scale, False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
