"""Exact nearest neighbours by balls: the triangle inequality tells which cells around pivots a query has to visit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.shared import materialize

#: Most pivots (their matrix is broadcast); rows and queries that a task holds.
MAX_PIVOTS, BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192, 1024


def _stack(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float64)


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


class Balls:
    """Pivots, the balls around them, and how a metric becomes a length: Euclidean as it is, cosine on the unit sphere."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.metric = metric
        self.pivots = self.points(pivots)
        self.radius, self.count = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)

    def points(self, x: np.ndarray) -> np.ndarray:
        return x if self.metric == "l2" else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-150)

    def length(self, distance: np.ndarray) -> np.ndarray:
        """The length of a distance: its root; on the unit sphere a chord has twice the cosine distance as its square."""
        return np.sqrt(np.maximum(distance, 0) * (1 if self.metric == "l2" else 2))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance from the pivot; a zero vector has a distance of its own to all under cosine, so its ball is endless."""
        y = self.points(x)
        d = _apart(y, self.pivots)
        cell = d.argmin(1)
        far = d[np.arange(len(x)), cell]
        return cell, far if self.metric == "l2" else np.where((x != 0).any(1), far, np.inf)

    def first(self, q: np.ndarray, least: int) -> np.ndarray:
        """(queries, cells): the nearest cells that hold `least` rows together."""
        order = np.argsort(_apart(self.points(q), self.pivots), axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < least, axis=1)
        return out & (self.count > 0)

    def reached(self, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(queries, cells): the balls, and the sides of the planes between pivots, that a query's radius `reach` touches."""
        y = self.points(q)
        d = _apart(y, self.pivots)
        # what rounding may add to a length
        slack = 1e-6 * (np.linalg.norm(y, axis=1) + np.linalg.norm(self.pivots, axis=1).max(initial=0) + 1)[:, None]
        r = reach[:, None] + slack
        near = d.argmin(1)
        gap = _apart(self.pivots[near], self.pivots)
        # a row of another cell is at least as far away as the plane between that cell's pivot and the nearest one
        plane = (d**2 - d[np.arange(len(q)), near][:, None] ** 2) / np.maximum(2 * gap, 1e-150)
        beyond = (plane > r) & (gap > 0) & np.isfinite(self.radius)[None, :]
        return (d - self.radius[None, :] <= r) & ~beyond & (self.count > 0)


def balls_of(rows: DataFrame, metric: str) -> tuple[Balls, DataFrame]:
    """Pivots for (id, embedding), about the root of the number of rows, chosen by a hash of the ids; and the rows with their cell."""
    n = rows.count()
    wanted = max(1, min(MAX_PIVOTS, round(n**0.5)))
    some = rows.select("embedding").orderBy(F.xxhash64("id", F.lit("balls")), "id").limit(wanted).toPandas()
    balls = Balls(np.unique(_stack(some["embedding"]), axis=0) if n else np.zeros((1, 1)), metric)
    shared = rows.sparkSession.sparkContext.broadcast(balls)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 2048):
                part = pdf.iloc[k : k + 2048]
                cell, far = shared.value.home(_stack(part["embedding"]))
                yield part.assign(cell=cell, far=far)

    dealt = materialize(rows.mapInPandas(cells, f"id {rows.schema['id'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, cell long, far double"))
    # a row for each pivot
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        balls.count[r["cell"]], balls.radius[r["cell"]] = r["n"], r["far"]
    return balls, dealt.drop("far")


def _copies(part: pd.DataFrame, i: np.ndarray, c: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows i of part with their cells c, some at a time: a query may go to thousands of cells."""
    for k in range(0, len(i), 4096):
        yield part.iloc[i[k : k + 4096]][["query_id", "q"]].assign(cell=c[k : k + 4096])


def _routed(asks: DataFrame, balls: Balls, cells: Callable[[Balls, pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, q, cell): the queries with the cells that `cells` names."""
    shared = asks.sparkSession.sparkContext.broadcast(balls)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                i, c = np.nonzero(cells(shared.value, part, _stack(part["q"])))
                yield from _copies(part, i, c)

    return asks.mapInPandas(route, f"query_id {asks.schema['query_id'].dataType.simpleString()}, q {asks.schema['q'].dataType.simpleString()}, cell long")


def _visited(dealt: DataFrame, routed: DataFrame, balls: Balls, best: Callable, out: str) -> DataFrame:
    """The k best of every visit. A cell is cut into blocks, and a block's queries into loads, so that a task holds few of both."""
    spark = dealt.sparkSession
    loads = {r["cell"]: max(1, -(-r["n"] // BLOCK_QUERIES)) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = spark.createDataFrame([(c, max(1, -(-int(balls.count[c]) // BLOCK_ROWS)), n) for c, n in loads.items()], "cell long, blocks long, loads long")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt.join(F.broadcast(cut), "cell").withColumn("block", deal("id", "blocks")).withColumn("load", span("loads")).select("cell", "block", "load", "id", "embedding")
    right = routed.join(F.broadcast(cut), "cell").withColumn("load", deal("query_id", "loads")).withColumn("block", span("blocks")).select("cell", "block", "load", "query_id", "q")
    right = right.toDF("cell_", "block_", "load_", "query_id", "q")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}, dtype=object)
        return best(y["query_id"].to_numpy(), _stack(y["q"]), x["id"].to_numpy(), _stack(x["embedding"]))

    return left.groupBy("cell", "block", "load").cogroup(right.groupBy("cell_", "block_", "load_")).applyInPandas(meet, out)


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def visits(dealt: DataFrame, asks: DataFrame, balls: Balls, best: Callable, out: str, k: int, own: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k best hits of every query in its nearest cells, those cells, and the further cells that it has to visit.

    A query first meets the nearest cells that hold k rows (and one more where its own row is among them and doesn't count).
    The kth of these hits is as far as any of the k nearest can be; of the other cells those count that this reaches.
    """
    least = k + own
    near = materialize(_routed(asks, balls, lambda b, _, q: b.first(q, least)))
    hits = materialize(_top(_visited(dealt, near, balls, best, out), k).drop("rank"))
    kth = hits.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    rest = asks.join(kth, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    shared = asks.sparkSession.sparkContext.broadcast(balls)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for pdf in batches:
            for s in range(0, len(pdf), 512):
                part = pdf.iloc[s : s + 512]
                q, kth = _stack(part["q"]), part["kth"].astype(float).to_numpy()
                endless = np.isnan(kth) | ((b.metric != "l2") & ~(q != 0).any(1))
                reach = np.where(endless, np.inf, b.length(np.nan_to_num(kth)))
                i, c = np.nonzero(b.reached(q, reach) & ~b.first(q, least))
                yield from _copies(part, i, c)

    far = materialize(rest.mapInPandas(route, f"query_id {asks.schema['query_id'].dataType.simpleString()}, q {asks.schema['q'].dataType.simpleString()}, cell long"))
    return hits, near, far


def pairs(routed: DataFrame, balls: Balls) -> int:
    """How many distances the visits cost."""
    return sum(r["n"] * int(balls.count[r["cell"]]) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())


def nearest_by_balls(balls: Balls, dealt: DataFrame, asks: DataFrame, best: Callable, out: str, k: int, own: bool) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of (query_id, q) among the rows of `balls_of`, exactly, for metric l2 or cosine.

    Every row belongs to the cell of its nearest pivot, every cell has a ball. Rows stay in their cells; queries are sent to
    the cells that they have to visit, so clustered vectors cost a share of all pairs. Where nothing is clustered every ball is reached, and
    a query would be copied once for each cell.
    """
    hits, _, far = visits(dealt, asks, balls, best, out, k, own)
    return _top(hits.unionByName(_visited(dealt, far, balls, best, out)), k).select("query_id", "rank", "id", "distance")
