"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.shared import fresh, materialize, shared_dir

__all__ = ["Forest", "components", "fresh", "materialize", "release", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data set; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b): one row (node, component_id) per node on an edge, component_id the smallest reachable node.

    Each round hooks every remaining root to its smallest neighbour, jumps pointers once more, and contracts
    the edges, so the edge table shrinks by a factor a round. All state stays in distributed tables; a hub
    node costs one partially aggregated key. Null ends and self links are dropped; an empty input gives no rows.
    """
    live = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        hook = live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        hook = materialize(hook)
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hook = materialize(hook.join(above, "up", "left").select("node", F.coalesce("up2", "up").alias("up")))
        if labels is None:
            ends = live.select(F.col("hi").alias("node")).union(live.select(F.col("lo").alias("node"))).distinct()
            labels = ends.select("node", F.col("node").alias("root"))
        labels = materialize(
            labels.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        up_hi = hook.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
        up_lo = hook.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        moved = (
            live.join(up_hi, "hi", "left").join(up_lo, "lo", "left")
            .select(F.coalesce("hi_up", "hi").alias("x"), F.coalesce("lo_up", "lo").alias("y"))
        )
        live = materialize(
            moved.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        node = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "node long, component_id long").select(
            F.col("node").cast(node).alias("node"), F.col("component_id").cast(node).alias("component_id")
        )
    return labels.select("node", F.col("root").alias("component_id"))


class Forest:
    """Union-find over row numbers that keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.label[i], self.label[j]
        apart = x != y
        if not apart.any():
            return
        _, first = np.unique(np.minimum(x, y)[apart] * len(self.label) + np.maximum(x, y)[apart], return_index=True)
        i, j, x, y = i[apart][first], j[apart][first], x[apart][first], y[apart][first]
        up: dict[int, int] = {}

        def root(v: int) -> int:
            top = v
            while top in up:
                top = up[top]
            while v != top:
                up[v], v = top, up[v]
            return top

        for a, b, p, q in zip(i.tolist(), j.tolist(), x.tolist(), y.tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                self.edges.append((a, b))
        move = np.arange(len(self.label))
        for v in list(up):
            move[v] = root(v)
        self.label = move[self.label]
