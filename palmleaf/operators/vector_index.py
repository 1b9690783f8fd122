"""A persistent approximate index: inverted lists by coarse centroid, product-quantised residuals, exact re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palmleaf.operators.search import _leading, nearest
from palmleaf.shared import materialize

#: Most rows, and bytes of their vectors, that the centroids are trained on; they are chosen by a hash of the id.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
#: Most rows that a file of a cell holds and that a search task scans, most queries that it takes along, and the fewest parts that more
#: than a few of either are dealt into; those few.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_BLOCKS, FEW_ROWS, FEW_QUERIES = 65_536, 2048, 6, 512, 64
#: Distances that are in memory at once, rows that are decoded at once, and candidates that a search task returns and keeps twice over.
TILE, DECODED, MOST_KEPT = 1 << 19, 4096, 1 << 19
#: Most partitions of a search, each of which takes one bundle with one load, or more where there are more.
MOST_TASKS = 2048
#: Numbers of a code, so that it is one byte.
CODES = 256
_BOOK = "kind string, no int, vector array<double>"


@dataclass(frozen=True)
class Codebook:
    """Coarse centroids (cells, dims) and, for each stretch of dimensions, the centroids of residuals there (parts, CODES, width)."""

    cells: np.ndarray
    parts: np.ndarray

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first, ties to the smaller number."""
        if n == 1 and len(self.cells):
            return _closest(x, self.cells)[0][:, None]
        out = np.empty((len(x), min(n, len(self.cells))), np.int64)
        for s, d in _tiles(x, self.cells):
            out[s : s + len(d)] = np.argsort(d, axis=1, kind="stable")[:, :n]
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """One byte for each part: the nearest residual centroid."""
        rest = _split(x - self.cells[cell], len(self.parts), self.parts.shape[2])
        return np.stack([_closest(rest[:, p], self.parts[p])[0] for p in range(len(self.parts))], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that the codes (rows, parts) of a cell stand for."""
        pieces = self.parts[np.arange(len(self.parts)), codes].reshape(len(codes), -1)
        return self.cells[cell] + pieces[:, : self.cells.shape[1]]


def _split(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width): the stretches of each row, zeros behind its end."""
    wide = np.zeros((len(x), parts * width))
    wide[:, : x.shape[1]] = x
    return wide.reshape(len(x), parts, width)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _tiles(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances to all of c), so many rows at a time that TILE distances are in memory."""
    step = max(1, TILE // max(1, len(c)))
    for s in range(0, len(x), step):
        yield s, _squared(x[s : s + step], c)


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest of c, the first of equals, and its squared distance; TILE distances are in memory."""
    at, far, step = np.empty(len(x), np.int64), np.empty(len(x)), max(1, TILE // max(1, len(c)))
    # what a row's own length adds changes no order
    b = np.c_[-2 * c, (c * c).sum(1)].T
    for s in range(0, len(x), step):
        y = x[s : s + step]
        d = np.c_[y, np.ones(len(y))] @ b
        at[s : s + step] = d.argmin(1)
        far[s : s + step] = np.maximum(d[np.arange(len(y)), at[s : s + step]] + (y * y).sum(1), 0)
    return at, far


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids by rounds of assigning and averaging, from rows drawn far apart; with fewer different rows, those."""
    r = np.random.default_rng(seed)
    c = x[[r.integers(len(x))]]
    near = _closest(x, c)[1]
    while len(c) < k and near.max() > 0:
        # several at a time, by their distance to those there are
        new = x[np.unique(r.choice(len(x), min(k - len(c), max(1, k // 8)), p=near / near.sum()))]
        c = np.concatenate([c, new])
        near = np.minimum(near, _closest(x, new)[1])
    for _ in range(rounds):
        at = _closest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, v, len(c)) for v in x.T], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _whole(c: str) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def train(vectors: DataFrame, cells: int, parts: int) -> DataFrame:
    """The codebook (kind, no, vector) of (id, embedding): `cells` coarse centroids, and CODES centroids for each of `parts` stretches.

    Trained on at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes, the first by a hash of their id; more rows cost more by their cells only, and
    no more memory. One task finds the coarse centroids; the parts' are found side by side, a task each, from their own stretches.
    """
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(cells, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    # a hash below a share that gives the sample's size, some more rows, so that the sort is of few
    count = max(1, vectors.count())
    lot = F.pmod(F.xxhash64("id", F.lit("index")), F.lit(1 << 30))
    few = vectors.where(lot <= int(min(1.0, 1.2 * rows / count + 1000 / count) * (1 << 30)))
    sample = few.orderBy(lot, "id").limit(rows).select("embedding")
    one = sample.withColumn("part", F.lit(0))

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        c = centres(_matrix(pdf["embedding"]), cells)
        return pd.DataFrame({"kind": "cell", "no": range(len(c)), "vector": list(c)})

    found = one.groupBy("part").applyInPandas(coarse, _BOOK).toPandas().sort_values("no")
    if not len(found):
        return vectors.sparkSession.createDataFrame([], _BOOK)
    c, width = _matrix(found["vector"]), -(-dims // parts)
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["embedding"])
                rest = _split(x - shared.value[_closest(x, shared.value)[0]], parts, width)
                for p in range(parts):
                    yield pd.DataFrame({"part": p, "piece": list(rest[:, p])})

    def fine(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        got = centres(_matrix(pdf["piece"]), CODES)
        # fewer different pieces than codes: the rest repeat the first, which never changes a nearest code
        full = np.concatenate([got, np.repeat(got[:1], CODES - len(got), 0)])
        return pd.DataFrame({"kind": "part", "no": part * CODES + np.arange(CODES), "vector": list(full)})

    # a number of its own, as a part is much work and few bytes
    pieces = sample.mapInPandas(stretches, "part int, piece array<double>").repartition(parts, "part").groupBy("part").applyInPandas(fine, _BOOK)
    spark = vectors.sparkSession
    return spark.createDataFrame([("cell", k, v.tolist()) for k, v in enumerate(c)], _BOOK).unionByName(pieces)


def _bundles(sizes: dict[int, int], asked: dict[int, int], cells: int, probes: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell the first bundle of its rows, the number of bundles that they are dealt into, and that of the loads of queries of each.

    A bundle is what a search task scans: cells that have a block of rows together, or a part of one that has more. So a query comes out with `most`
    candidates for each bundle, not for each cell.
    """
    first, blocks, loads = np.zeros((3, cells), np.int64)
    rows = max(1, min(BLOCK_ROWS, max(FEW_ROWS, -(-sum(sizes.values()) // LEAST_BLOCKS))))
    # every query is asked of `probes` cells
    total = -(-sum(asked.values()) // max(1, probes))
    load = max(1, min(BLOCK_QUERIES, MOST_KEPT // most, max(FEW_QUERIES, -(-total // LEAST_BLOCKS))))
    last, held, asks = -1, rows, {}
    for c in sorted(sizes):
        blocks[c] = -(-sizes[c] // rows)
        if held + sizes[c] > rows:
            first[c], last, held = last + 1, last + blocks[c], 0
        else:
            first[c] = last
        held += sizes[c]
        asks[first[c]] = min(total, asks.get(first[c], 0) + asked[c])
    for c in sizes:
        loads[c] = max(1, -(-asks[first[c]] // load))
    return first, blocks, loads


def _sent(part: pd.DataFrame, near: np.ndarray, first: np.ndarray, blocks: np.ndarray, loads: np.ndarray) -> pd.DataFrame:
    """Queries with their nearest cells as (query_id, q, bundle, loads, cells): a row for each bundle that has rows of these."""
    of, c = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    n = blocks[c]
    ends = np.cumsum(n)
    of, c, no = np.repeat(of, n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(ends - n, n)
    bundle = first[c] + no
    by = np.lexsort((bundle, of))
    of, c, bundle = of[by], c[by], bundle[by]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (bundle[1:] != bundle[:-1])][: len(of)])
    out = part.iloc[of[new]].reset_index(drop=True)
    return out.assign(bundle=bundle[new], loads=loads[c[new]], cells=pd.Series(np.split(c, new[1:]) if len(new) else [], dtype=object))


def _candidates(book: Codebook, ids: np.ndarray, cell: np.ndarray, codes: np.ndarray, asked: np.ndarray, q: np.ndarray, of: np.ndarray, c: np.ndarray, most: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance by the codes) of each query's `most` first rows, ties to the smaller id, among those of its cells.

    Rows are in the order of their ids; `of` and `c` are queries and their cells. A query's `most`th distance so far bars what comes, so few rows are kept.
    """
    by_row, by_ask = np.argsort(cell, kind="stable"), np.argsort(c, kind="stable")
    cells, of, c = cell[by_row], of[by_ask], c[by_ask]
    bar, found, count = np.full(len(q), np.inf), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    limit = 2 * max(MOST_KEPT, len(q) * most)

    def led() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate(v) for v in zip(*found, strict=True))
        at = _leading(i, j, d, k=most)
        i, j, d = i[at], j[at], d[at]
        end = np.searchsorted(i, np.arange(len(q)), "right")
        full = np.bincount(i, minlength=len(q)) >= most
        bar[full] = d[end[full] - 1]
        return i, j, d

    for one in np.unique(cells):
        rows = by_row[np.searchsorted(cells, one) : np.searchsorted(cells, one, "right")]
        mine = of[np.searchsorted(c, one) : np.searchsorted(c, one, "right")]
        for s in range(0, len(rows) if len(mine) else 0, DECODED):
            some = rows[s : s + DECODED]
            about, step = book.decode(codes[some], one), max(1, TILE // len(some))
            for t in range(0, len(mine), step):
                few = mine[t : t + step]
                d = _squared(q[few], about)
                hit = np.flatnonzero(d <= bar[few][:, None])
                i, j, d = few[hit // len(some)], some[hit % len(some)], d.ravel()[hit]
                if skip_self:
                    other = asked[i] != ids[j]
                    i, j, d = i[other], j[other], d[other]
                found.append((i, j, d))
                count += len(i)
                if count > limit:
                    found = [led()]
                    count = len(found[0][0])
    return led()


class VectorIndex:
    """An index under a folder: `book`, the codebook, and `lists`, the rows (id, code, embedding) in a folder for each cell.

    Every row of a finite vector is in exactly one list. A search reads the folders of the probed cells only, of these first
    ids and codes, and vectors for the rows that are left to rank.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/book").toPandas().sort_values("no")
        pick = lambda kind: _matrix(rows[rows["kind"] == kind]["vector"])
        flat = pick("part")
        self.book = Codebook(pick("cell"), flat.reshape(-1, CODES, flat.shape[1]) if len(flat) else np.zeros((1, CODES, 1)))
        self.kind = spark.read.parquet(f"{self.path}/kind").schema

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, parts: int = 16, train_on: DataFrame | None = None) -> VectorIndex:
        """Train on `vectors` (id, embedding), or on `train_on`, and index every row; about sqrt(rows) cells unless `cells` says
        otherwise. Rows with a null id, or whose vector is null or holds a null or non-finite component, aren't indexed; all
        vectors have one length. An index that is there is replaced."""
        rows = vectors.select("id", "embedding").where("id is not null").where(_whole("embedding"))
        book = train(train_on.select("id", "embedding").where("id is not null").where(_whole("embedding")) if train_on is not None else rows, cells or max(1, min(4096, round(rows.count() ** 0.5))), parts)
        book.write.mode("overwrite").parquet(f"{path.rstrip('/')}/book")
        rows.limit(0).select("id", F.lit(b"").alias("code"), "embedding", F.lit(0).alias("cell")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/kind")
        index = cls(vectors.sparkSession, path)
        index._write(rows, "overwrite")
        return index

    def add(self, vectors: DataFrame) -> None:
        """Index more rows with the codebook there is; the caller sees to it that their ids are new. Where rows change or go, build anew."""
        self._write(vectors.select("id", "embedding").where("id is not null").where(_whole("embedding")), "append")

    def lists(self) -> DataFrame:
        """(id, code, embedding, cell) of all rows; a filter on cell is one on folders."""
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/lists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        shared = self.spark.sparkContext.broadcast(self.book)
        kind = rows.schema["embedding"].dataType.simpleString()
        of = rows.schema["id"].dataType.simpleString()

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf["embedding"])
                    cell = shared.value.nearest_cells(x, 1)[:, 0]
                    yield pd.DataFrame({"id": pdf["id"], "code": [c.tobytes() for c in shared.value.encode(x, cell)], "embedding": pdf["embedding"], "cell": cell.astype(np.int32)})

        coded = materialize(rows.mapInPandas(code, f"id {of}, code binary, embedding {kind}, cell int"))
        # a cell of more rows than a slot's share is dealt out by id, so that one with a third of all rows is many files and tasks; there
        # are no more files than cells and slots, or blocks of rows
        slots = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        share = min(BLOCK_ROWS, max(FEW_ROWS // 2, -(-coded.count() // slots)))
        cut = F.broadcast(coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / share).alias("files")))
        dealt = coded.join(cut, "cell").repartition(slots, "cell", F.pmod(F.xxhash64("id"), F.col("files"))).drop("files")
        dealt.sortWithinPartitions("cell", "id").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/lists")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, q, cell): each query with its `probes` nearest cells."""
        return self._routed(queries, probes, lambda part, near: part.assign(cells=list(near)), "cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))

    def _routed(self, queries: DataFrame, probes: int, to: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], more: str) -> DataFrame:
        """(query_id, q) and the columns `more` that `to` adds to some queries with their `probes` nearest cells."""
        asks = queries.select("query_id", F.col("embedding").alias("q")).where("query_id is not null").where(_whole("q"))
        shared = self.spark.sparkContext.broadcast(self.book)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                step = max(1, TILE // max(1, len(shared.value.cells)))
                for s in range(0, len(pdf) if len(shared.value.cells) else 0, step):
                    part = pdf.iloc[s : s + step].reset_index(drop=True)
                    yield to(part, shared.value.nearest_cells(_matrix(part["q"]), probes).astype(np.int32))

        return asks.mapInPandas(route, f"query_id {asks.schema['query_id'].dataType.simpleString()}, q {asks.schema['q'].dataType.simpleString()}, {more}")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, refine: int = 8, skip_self: bool = False) -> DataFrame:
        """(query_id, rank, id, distance): k near rows of each query (query_id, embedding) under squared Euclidean distance, ties to the smaller id.

        The lists of the `probes` nearest cells are scanned by their codes, many cells and queries in a task, of which each query comes out with its
        refine * k first rows. Of all its tasks' rows it keeps as many candidates, whose vectors are then read and ranked exactly. What is lost
        is what lies in other cells or falls behind by its code; more probes and a higher `refine` lose less.
        """
        most = k * refine
        # no more numbers than there are cells
        asked = {r["cell"]: r["n"] for r in self.probed(queries, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        lists = self.lists().where(F.col("cell").isin(sorted(asked))) if asked else self.lists().where(F.lit(False))
        sizes = {r["cell"]: r["n"] for r in lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, blocks, loads = _bundles(sizes, asked, len(self.book.cells), min(probes, len(self.book.cells)), most)
        cut = self.spark.createDataFrame([(c, int(first[c]), int(blocks[c]), int(loads[c])) for c in sizes], "cell int, first long, blocks long, loads long")
        shared = self.spark.sparkContext.broadcast(self.book)
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        left = lists.select("cell", "id", "code").join(F.broadcast(cut), "cell").withColumn("load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)))
        left = left.select((F.col("first") + deal("id", "blocks")).alias("bundle"), "load", "cell", "id", "code")
        send = lambda part, near: _sent(part, near, first, blocks, loads)
        right = self._routed(queries, probes, send, "bundle long, loads long, cells array<int>")
        right = right.select(F.col("bundle").alias("bundle_"), deal("query_id", "loads").alias("load_"), "query_id", "q", "cells")
        ids, asks = left.schema["id"].dataType.simpleString(), right.schema["query_id"].dataType.simpleString()

        def scan(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"query_id": [], "cell": [], "id": [], "about": []}, dtype=object)
            x = x.sort_values("id")
            codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
            rows, cell, asked, near = x["id"].to_numpy(), x["cell"].to_numpy(), y["query_id"].to_numpy(), y["cells"].tolist()
            of, c = np.repeat(np.arange(len(y)), [len(v) for v in near]), np.concatenate(near)
            i, j, about = _candidates(shared.value, rows, cell, codes, asked, _matrix(y["q"]), of, c, most, skip_self)
            return pd.DataFrame({"query_id": asked[i], "cell": cell[j], "id": rows[j], "about": about})

        # a number of its own, as a bundle and a load are much work and few bytes
        tasks = max(1, min(MOST_TASKS, sum({int(first[c]) + n: int(loads[c]) for c in sizes for n in range(blocks[c])}.values())))
        left, right = left.repartition(tasks, "bundle", "load"), right.repartition(tasks, "bundle_", "load_")
        near = left.groupBy("bundle", "load").cogroup(right.groupBy("bundle_", "load_")).applyInPandas(scan, f"query_id {asks}, cell int, id {ids}, about double")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("about", "id"))
        few = near.withColumn("place", first).where(F.col("place") <= most).select("query_id", "cell", "id")
        full = few.join(lists.select("cell", "id", "embedding"), ["cell", "id"]).join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
        apart = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda s, d: s + d * d)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return full.select("query_id", "id", F.round(apart, 12).alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    def probes_for(self, target: float = 0.95, k: int = 5, sample: int = 256) -> int:
        """The fewest probes that find the share `target` of the k true neighbours of up to `sample` indexed rows.

        The rows are chosen by a hash of their id and compared with all; where a true neighbour's cell stands among the cells nearest to its
        row tells how many probes reach it. What codes lose comes on top. Vectors without clusters need many probes.
        """
        rows, some, near = self._truth(k, sample)
        asks = some.toPandas()
        if not len(asks):
            return 1
        place = np.empty((len(asks), len(self.book.cells)), np.int64)
        np.put_along_axis(place, self.book.nearest_cells(_matrix(asks["embedding"]), place.shape[1]), np.arange(place.shape[1])[None, :], 1)
        at = {q: k for k, q in enumerate(asks["query_id"])}
        # at most sample * k rows
        needed = sorted(place[at[r["query_id"]], r["cell"]] + 1 for r in near.join(rows.select("id", "cell"), "id").collect())
        return int(needed[max(0, -(-int(1e6 * target) * len(needed) // 10**6) - 1)]) if needed else 1

    def refine_for(self, probes: int, target: float = 0.93, k: int = 5, sample: int = 256, most: int = 4096) -> int:
        """The first of 8, 16, ... `most` candidates for each hit at which a search with so many probes finds the share `target` of the k true
        neighbours of the rows that `probes_for` takes. The more rows there are, the more of them have codes like a neighbour's."""
        _, some, near = self._truth(k, sample)
        near, refine = materialize(near), 8
        while refine < most:
            got = recall(self.search(some, k, probes, refine, skip_self=True), near).first()
            if got["found"] >= target * got["wanted"]:
                break
            refine *= 2
        return refine

    def _truth(self, k: int, sample: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All rows, up to `sample` of them as queries, chosen by a hash of their id, and those queries' true neighbours (query_id, id)."""
        rows = self.lists().select("id", "embedding", "cell")
        # read several times
        some = materialize(rows.orderBy(F.xxhash64("id", F.lit("tune")), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding"))
        return rows, some, nearest(rows.select("id", "embedding"), some, k, skip_self=True).select("query_id", "id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, found): how many rows of `exact` (query_id, id) there are, and how many of them are in `found`."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
