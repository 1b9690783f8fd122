"""Near-duplicate vectors: an exact metric range join over pivot cells with boundary replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, materialize
from .topk_search import matrix, usable

#: Vectors a cell should own; most pivots there may be (their matrix is broadcast); rows of a block within a cell.
CELL_ROWS, MAX_PIVOTS, BLOCK_ROWS = 8192, 4096, 16384
_SLACK = 1e-9
_OUT = "id long, weight long, other long"


def _units(vectors: pd.Series, width: int) -> np.ndarray:
    x = matrix(vectors, width)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_between(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= least, in pieces. Single precision decides all but close calls."""
    a32, b32, margin = a.astype(np.float32), b.astype(np.float32), 1e-5
    for k in range(0, len(a), 256):
        near = a32[k : k + 256] @ b32.T
        i, j = np.nonzero(near >= least - margin)
        close = near[i, j] < least + margin
        ok = ~close
        ok[close] = np.einsum("ij,ij->i", a[i[close] + k], b[j[close]]) >= least
        yield i[ok] + k, j[ok]


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding): links join vectors of cosine >= `least`.

    Equal vectors are one point with a weight. A bounded sample of points are pivots; a point belongs to the cell of
    its nearest pivot. With r the chord length of the cosine bound, a neighbour v (of pivot h) of a point of cell i has,
    by the triangle inequality, d(v, i) <= d(v, h) + 2r, and lies within r of the plane between the two pivots: into
    all cells that both allow v is copied. So each cell finds all links of its own points alone; a large cell is cut into
    blocks, and each pair of blocks is a task. Links are counted, and of the edges only spanning forests leave a task.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; shorter vectors count as
    ended by zeros; a null id keeps a null component. Rows that repeat an id are vectors of their own with that id.
    """
    rows = vectors.select("vec_id", "embedding")
    spark = rows.sparkSession
    good = F.coalesce(usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    points = materialize(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("width")).first()
    n, width = size["n"], size["width"]
    wanted = max(1, min(MAX_PIVOTS, -(-n // CELL_ROWS)))
    sample = points.orderBy(F.xxhash64("id", F.lit("pivots")), "id").limit(wanted).select("embedding").collect()
    pivots = np.unique(np.round(_units(pd.Series([r["embedding"] for r in sample]), width), 12), axis=0) if sample else np.zeros((1, width))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    shared = spark.sparkContext.broadcast((pivots, apart))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, gap = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), 2048):
                part = pdf.iloc[k : k + 2048]
                x = _units(part["embedding"], width)
                cos = x @ p.T
                home = cos.argmax(1)
                own = cos[np.arange(len(x)), home]
                far, far_own = np.sqrt(np.maximum(2 - 2 * cos, 0)), np.sqrt(np.maximum(2 - 2 * own, 0))
                to = far <= far_own[:, None] + 2 * reach + _SLACK
                to &= own[:, None] - cos <= reach * gap[home] + _SLACK
                to[np.arange(len(x)), home] = True
                i, c = np.nonzero(to)
                got = part.iloc[i]
                yield pd.DataFrame({"cell": c, "home": home[i] == c, "id": got["id"].to_numpy(), "weight": got["weight"].to_numpy(), "embedding": got["embedding"].to_numpy()})

    kind = points.schema["embedding"].dataType.simpleString()
    dealt = materialize(points.mapInPandas(cells, f"cell long, home boolean, id long, weight long, embedding {kind}"))
    # at most MAX_PIVOTS rows
    counts = dealt.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("own"), F.count(F.lit(1)).alias("all")).collect()
    parts = {r["cell"]: (max(1, -(-r["own"] // BLOCK_ROWS)), max(1, -(-r["all"] // BLOCK_ROWS))) for r in counts}
    cut = spark.createDataFrame([(c, a, b) for c, (a, b) in parts.items()], "cell long, own_blocks long, all_blocks long")
    dealt = dealt.join(F.broadcast(cut), "cell")
    block = lambda n, name: F.pmod(F.xxhash64("id", F.lit(name)), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = dealt.where("home").withColumn("x", block("own_blocks", "own")).withColumn("y", span("all_blocks")).select("cell", "x", "y", "id", "embedding").toDF("cell_", "x_", "y_", "id", "embedding")
    near = dealt.withColumn("y", block("all_blocks", "all")).withColumn("x", span("own_blocks")).select("cell", "x", "y", "id", "weight", "embedding")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "weight": [], "other": []}, dtype="Int64")
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        w = right["weight"].to_numpy()
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest, total = Forest(len(ids)), np.zeros(len(a), np.int64)
        for i, j in links_between(_units(left["embedding"], width), _units(right["embedding"], width), least):
            np.add.at(total, i, w[j])
            forest.add(place[i], place[len(a) + j])
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        some = np.flatnonzero(total)
        return pd.DataFrame(
            {
                "id": np.concatenate([a[some], ids[edges[:, 0]]]),
                "weight": pd.array(np.concatenate([total[some], np.zeros(len(edges), np.int64)]), "Int64"),
                "other": pd.array(ids[edges[:, 1]].tolist() if not len(some) else [pd.NA] * len(some) + ids[edges[:, 1]].tolist(), "Int64"),
            }
        )

    found = materialize(own.groupBy("cell_", "x_", "y_").cogroup(near.groupBy("cell", "x", "y")).applyInPandas(match, _OUT))
    links = found.where("other is null").groupBy("id").agg(F.sum("weight").alias("links"))
    classes = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    state = (
        points.join(links, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
        .select("embedding", (F.coalesce("links", "weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    linked = rows.where(good).join(materialize(state), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
