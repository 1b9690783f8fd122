"""Nearest-vector search: exact, and approximate by random projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.operators.balls import Balls, balls_of, nearest_by_balls
from palmleaf.shared import materialize

#: Most queries whose vectors are broadcast; more go to balls or are dealt into blocks that meet blocks of candidates.
BROADCAST_QUERIES = 1024
#: Bytes of a block's vectors as they come, the fewest blocks a side that more than a few rows are dealt into, and those few.
BLOCK_BYTES, LEAST_BLOCKS, FEW_ROWS = 32 << 20, 6, 512
#: Queries that tell whether balls spare work, and the share of all pairs above which they don't.
TRIAL, WORTH = 128, 0.25
#: Pairs that one query tile may keep before it ranks them exactly; pairs whose exact distances are worked out at once; rows that are in double precision at once.
MOST_KEPT, PAIRS, WIDE_ROWS = 1 << 18, 1 << 15, 4096


def _stack(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float64)


def _wide(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows in double precision, under cosine of length 1."""
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-150) if metric == "cosine" else v


def _slices(v: np.ndarray, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows in double precision), some rows at a time."""
    for s in range(0, len(v), WIDE_ROWS):
        yield s, _wide(v[s : s + WIDE_ROWS], metric)


class _Screen:
    """Scores a @ b.T in single precision, if the components allow it, that order each query's rows as their distances do, and how far a query's
    may be off. Only `b` is as long as the rows; nothing of that length is in double precision."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        self.metric, dims = metric, x.shape[1]
        self.centre = sum(y.sum(0) for _, y in _slices(x, metric)) / len(x) if metric == "l2" else np.zeros(dims)
        most = self.wide = 0.0
        for _, y in _slices(x, metric):
            b = self._rows(y)
            most, self.wide = max(most, np.abs(b).max(initial=0)), max(self.wide, np.sqrt((b * b).sum(1)).max(initial=0))
        most = max([most, *(np.abs(self._asks(y)).max(initial=0) for _, y in _slices(q, metric))])
        self.kind = np.float32 if 1e-15 < most < 1e15 else np.float64
        self.b = np.empty((len(x), dims + (metric == "l2")), self.kind)
        for s, y in _slices(x, metric):
            self.b[s : s + len(y)] = self._rows(y)

    def _rows(self, y: np.ndarray) -> np.ndarray:
        if self.metric != "l2":
            return -y
        y = y - self.centre
        return np.c_[-2 * y, (y * y).sum(1)]

    def _asks(self, y: np.ndarray) -> np.ndarray:
        return np.c_[y - self.centre, np.ones(len(y))] if self.metric == "l2" else y

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a, and how far each of the scores may be off, of queries in double precision."""
        a = self._asks(q)
        # the sum of as many rounded products, each of two rounded factors
        return a.astype(self.kind), (a.shape[1] + 6) * np.finfo(self.kind).eps * np.sqrt((a * a).sum(1)) * self.wide + 2e-12


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """The distances of the pairs (i, j) in double precision, rounded at 12 digits, of queries by `_wide` and rows as they come."""
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        y, z = q[i[k : k + PAIRS]], _wide(x[j[k : k + PAIRS]], metric)
        out[k : k + PAIRS] = ((y - z) ** 2).sum(1) if metric == "l2" else 1.0 - (y * z).sum(1)
    return np.round(out, 12)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k smallest, ascending, the first of equals first."""
    if d.shape[1] <= 4 * k:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    # of those at the kth value the first ones count, which a partition doesn't tell
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    below, at = d < edge, d == edge
    keep = below | (at & (np.cumsum(at, axis=1) <= k - below.sum(1, keepdims=True)))
    few = np.nonzero(keep)[1].reshape(len(d), k)
    return np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, 1), axis=1, kind="stable"), 1)


def _leading(i: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k entries of each i, by `order`, most important last."""
    by = np.lexsort((*order, i))
    return by[np.arange(len(i)) - np.searchsorted(i[by], i[by]) < k]


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    """(query_id, id, distance) of each query's k nearest rows, ties to the smaller id; vectors with a component that isn't finite don't count.

    Products in single precision with a bound on their error leave a few rows for each query; their distances are worked out in double precision.
    """
    own, order = np.isfinite(q).all(1), np.argsort(ids, kind="stable")
    order = order[np.isfinite(x).all(1)[order]]
    qid, q, ids, x = qid[own], q if own.all() else q[own], ids[order], x[order]
    if not len(q) or not len(x):
        return _none()
    selves = np.empty((2, len(qid)), np.int64)
    alike = skip_self and (qid.dtype == object) == (ids.dtype == object)
    for side, row in zip(("left", "right"), selves, strict=True):
        row[:] = np.searchsorted(ids, qid, side) if alike else 0
    screen, found = _Screen(q, x, metric), []
    for s in range(0, len(q), 512):
        y = _wide(q[s : s + 512], metric)
        a, slack = screen.of(y)
        i, j = _tile(a, screen.b, slack, y, x, selves[:, s : s + 512], k, metric)
        d = _exact(y, x, i, j, metric)
        at = _leading(i, j, d, k=k)
        found.append((i[at] + s, j[at], d[at]))
    i, j, d = (np.concatenate(v) for v in zip(*found, strict=True))
    fine = np.isfinite(d)
    return pd.DataFrame({"query_id": qid[i[fine]], "id": ids[j[fine]], "distance": d[fine]})


def _tile(a: np.ndarray, b: np.ndarray, slack: np.ndarray, q: np.ndarray, x: np.ndarray, selves: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among a query's k nearest: those within its kth score so far and twice the slack."""
    bar = np.full(len(a), np.inf)
    i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, a.dtype)
    first, last = selves
    t, width = 0, max(1024, 4 * k)
    while t < len(b):
        block = a @ b[t : t + width].T
        mine = np.flatnonzero((first < last) & (first < t + width) & (last > t))
        for r in mine.tolist():
            block[r, max(first[r] - t, 0) : last[r] - t] = np.inf
        if t == 0 and block.shape[1] > k:
            bar = np.partition(block, k - 1, axis=1)[:, k - 1] + 2 * slack
        hit = np.flatnonzero(block <= _above(bar, block.dtype)[:, None])
        hit = hit[block.ravel()[hit] < np.inf]
        i, j, score = (np.concatenate(v) for v in ((i, hit // block.shape[1]), (j, hit % block.shape[1] + t), (score, block.ravel()[hit])))
        if len(i) > MOST_KEPT:
            at = _leading(i, j, _exact(q, x, i, j, metric), k=k)
            i, j, score = i[at], j[at], score[at]
        by = np.lexsort((score, i))
        i, j, score = i[by], j[by], score[by]
        begin, end = np.searchsorted(i, np.arange(len(a)), "left"), np.searchsorted(i, np.arange(len(a)), "right")
        full = end - begin >= k
        bar[full] = np.minimum(bar[full], score[begin[full] + k - 1].astype(float) + 2 * slack[full])
        near = score <= bar[i]
        i, j, score = i[near], j[near], score[near]
        t, width = t + width, max(4096, 4 * k)
    return i, j


def _above(bar: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The bar in a score's precision, not below what it was."""
    return np.nextafter(bar.astype(kind), kind.type(np.inf))


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "id": [], "distance": []}, dtype=object)


def whole(c: str) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def _matrix(x: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column without nulls, as rows, in the precision that they have."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in x.chunks if len(c)])


def _few_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with equal vectors those of the `most` smallest ids: no other can be among as many nearest of any query."""
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): each query's k nearest rows of `vectors` (id, embedding), ties to the smaller id.

    metric is l2 (squared), cosine or ip; distances are in double precision, rounded at 12 digits. Vectors that are null or hold a null or
    non-finite component don't count; all vectors have one length; ids are numbers or strings. Few queries are broadcast, and every Arrow
    batch keeps its own k best. Many go to the balls that they have to visit (see `balls`) if a trial shows that this spares pairs; else, and under
    ip, which is no metric, both sides are dealt into blocks that all meet. Filter `vectors` first to search a part.
    """
    rows = vectors.select("id", "embedding").where("id is not null").where(whole("embedding"))
    asks = queries.select("query_id", F.col("embedding").alias("q")).where("query_id is not null").where(whole("q"))
    out = f"query_id {asks.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    some = asks.limit(BROADCAST_QUERIES + 1).toPandas()
    if len(some) <= BROADCAST_QUERIES:
        return _ranked(_scanned(rows, some, k, metric, skip_self, out), k)
    rows = materialize(_few_copies(rows, k + skip_self))
    if metric != "ip" and not rows.isEmpty():
        balls, dealt = balls_of(rows, metric)
        if _spares(dealt, asks, balls, k, metric, skip_self, out):
            best = lambda qid, q, ids, x: _best(qid, q, ids, x, k, metric, skip_self)
            return nearest_by_balls(balls, dealt, asks, best, out, k, skip_self)
    return _ranked(_by_blocks(rows, asks, k, metric, skip_self, out), k)


def _spares(dealt: DataFrame, asks: DataFrame, balls: Balls, k: int, metric: str, skip_self: bool, out: str) -> bool:
    """Whether the balls that some queries, chosen by a hash, have to visit hold no more than a share WORTH of all pairs."""
    some = asks.orderBy(F.xxhash64("query_id", F.lit("trial")), "query_id").limit(TRIAL).toPandas()
    kth = _ranked(_scanned(dealt.select("id", "embedding"), some, k, metric, skip_self, out), k).groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    far = {r["query_id"]: r["kth"] if r["n"] >= k else np.inf for r in kth.collect()}
    q = _stack(some["q"])
    reach = balls.length(np.array([far.get(x, np.inf) for x in some["query_id"]]))
    return float((balls.reached(q, reach) * balls.count).sum()) <= WORTH * len(q) * balls.count.sum()


def _scanned(rows: DataFrame, some: pd.DataFrame, k: int, metric: str, skip_self: bool, out: str) -> DataFrame:
    """The k best of every Arrow batch for the queries `some`, which are broadcast."""
    qid, q = some["query_id"].to_numpy(), _stack(some["q"]) if len(some) else np.empty((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((qid, q))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _best(*shared.value, pdf["id"].to_numpy(), _stack(pdf["embedding"]), k, metric, skip_self)

    return rows.mapInPandas(scan, out)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _by_blocks(rows: DataFrame, asks: DataFrame, k: int, metric: str, skip_self: bool, out: str) -> DataFrame:
    """The k best hits of every pair of blocks. A task holds two blocks of BLOCK_BYTES, and a vector is shuffled once for each block of the other side."""
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    single = lambda df, c: df.schema[c].dataType.simpleString() == "array<float>"
    most = lambda df, c: max(FEW_ROWS, BLOCK_BYTES // ((4 if single(df, c) else 8) * dims))
    count = lambda n, most: max(1, min(LEAST_BLOCKS, n // FEW_ROWS), -(-n // most))
    blocks, groups = count(rows.count(), most(rows, "embedding")), count(asks.count(), most(asks, "q"))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = lambda df, c: F.col(c) if single(df, c) else F.col(c).cast("array<double>")
    left = rows.select("id", plain(rows, "embedding").alias("embedding"), deal("id", blocks).alias("block"), to_all(groups).alias("ask"))
    right = asks.select("query_id", plain(asks, "q").alias("q"), to_all(blocks).alias("block_"), deal("query_id", groups).alias("ask_"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", y.schema.field("query_id").type), ("id", x.schema.field("id").type), ("distance", pa.float64())])
        if not len(x) or not len(y):
            return schema.empty_table()
        ids = lambda t, c: t.column(c).to_pandas().to_numpy()
        got = _best(ids(y, "query_id"), _matrix(y.column("q")), ids(x, "id"), _matrix(x.column("embedding")), k, metric, skip_self)
        return pa.Table.from_pandas(got, schema, preserve_index=False)

    # a number of its own, as a pair of blocks is much work and few bytes
    left, right = left.repartition(blocks * groups, "block", "ask"), right.repartition(blocks * groups, "block_", "ask_")
    return left.groupBy("block", "ask").cogroup(right.groupBy("block_", "ask_")).applyInArrow(meet, out)


def nearest_approximate(vectors: DataFrame, queries: DataFrame, k: int = 5, within: float = 1.0, bucket: float = 2.0, tables: int = 8) -> DataFrame:
    """As `nearest` under Euclidean distance (squared in the result), but only among pairs that random projections put into
    a bucket together and that lie within `within`. Recall depends on bucket length and number of tables; nothing is exact here."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    shape = lambda df, key: df.where("embedding is not null").select(F.col(key).alias("key"), array_to_vector("embedding").alias("v"))
    rows, asks = shape(vectors, "id"), shape(queries, "query_id")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=11).fit(rows)
    pairs = model.approxSimilarityJoin(asks, rows, within, "d").select(
        F.col("datasetA.key").alias("query_id"), F.col("datasetB.key").alias("id"), (F.col("d") * F.col("d")).alias("distance")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
