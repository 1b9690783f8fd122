"""Exact n-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, materialize, release
from .shingles import shingle_sets

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle is frequent when a stretch of tokens shows it this often and all stretches together as often as LEAST_FREQUENT;
#: at most MAX_FREQUENT of them are kept (and broadcast). They only move to the end of every set's order.
STRETCH_COUNT, LEAST_FREQUENT, MAX_FREQUENT = 3, 16, 1 << 20
_STRETCH = 4_000_000
#: Most rows of a table of ids that are broadcast; beyond it Spark joins by shuffling.
MAX_BROADCAST_IDS = 500_000
#: Entries of an index list that are skipped or compared together; entries of a list, and sets of a cluster and the bytes of
#: their shingles, of which a task gets two blocks at most.
BLOCK, LIST_BLOCK, CLUSTER_BLOCK, CLUSTER_BYTES = 64, 256, 1024, 16 << 20
_SLICE = 1 << 19


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, owner among them, shingles) for slices of a batch (doc_id, text) of about _SLICE bytes."""
    ids, texts, held, at = batch.column(0), [], 0, 0
    for k, text in enumerate(batch.column(1).cast(pa.binary())):
        texts.append(text.as_py() or b"")
        held += len(texts[-1])
        if held >= _SLICE or k == batch.num_rows - 1:
            owner, value = shingle_sets(texts)
            yield ids[at : k + 1], owner, value
            texts, held, at = [], 0, k + 1


def _arrow(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the columns that a schema of longs, ints and binaries names; missing ones are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in fields])


def survey(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n, h1, h2) per document, with the size and a 128-bit digest of its set; and rows (token, seen) with
    the counts of shingles that are frequent in some stretch of the corpus (n is null there)."""

    schema = "doc_id long, n long, h1 long, h2 long, token long, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held = [], 0

        def frequent() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(stretch), return_counts=True) if stretch else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = seen >= STRETCH_COUNT
            return _arrow(schema, token=token[often].view(np.int64), seen=seen[often])

        for batch in batches:
            for ids, owner, value in _sets(batch):
                n = np.bincount(owner, minlength=len(ids))
                low, high = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
                np.add.at(low, owner, value)
                np.add.at(high, owner, value * (value >> np.uint64(7) | np.uint64(1)))
                yield _arrow(schema, doc_id=ids, n=n, h1=low.view(np.int64), h2=high.view(np.int64))
                stretch.append(value)
                held += len(value)
                if held >= _STRETCH:
                    yield frequent()
                    stretch, held = [], 0
        yield frequent()

    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def required(a, b):
    """The least intersection of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, doc, n, pos): the first shingles of every set in the global order - frequent ones last, by count, then by
    value - as many that linked sets must share one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    schema = "token long, doc long, n int, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for batch in batches:
            for ids, owner, value in _sets(batch):
                n = np.bincount(owner, minlength=len(ids))
                if len(tokens):
                    k = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
                    weight = np.where(tokens[k] == value, counts[k], 0)
                    some = np.flatnonzero(weight)
                    # a stable sort of the sets with frequent shingles moves those to their ends
                    mixed = np.isin(owner, owner[some])
                    part = np.flatnonzero(mixed)
                    order = np.lexsort((value[part], weight[part], owner[part]))
                    value = value.copy()
                    value[part] = value[part][order]
                pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
                size = n[owner]
                keep = pos < size - -(-PERCENT * size // 100) + 1
                yield _arrow(schema, token=value[keep].view(np.int64), doc=ids.take(pa.array(owner[keep])), n=size[keep].astype(np.int32), pos=pos[keep].astype(np.int32))

    return _keyed(docs).mapInArrow(run, schema)


def _small(rows: DataFrame) -> DataFrame:
    """`rows` of one or two numbers each, to be broadcast where they are few; their other side then isn't shuffled."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, items): the sets of the documents in `ids` (doc_id), their shingles as sorted 64-bit numbers."""

    schema = "doc long, items binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, owner, value in _sets(batch):
                cut = np.searchsorted(owner, np.arange(len(doc) + 1))
                items = [value[i:j].astype("<u8").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield _arrow(schema, doc=doc, items=items)

    return _keyed(docs.join(_small(ids), "doc_id")).mapInArrow(run, schema)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, sizes of the intersections of set k with every set), for all sets, the most similar ones after each other.

    An inverted index tells which sets hold an item. The answers of the hub, the set that shares most with all others, are
    counted from it in full. Another set's come from the answers of the hub or of the set before, whichever differs less: plus the
    sets of the items that it has more, minus those of the items that it lacks. So what near copies have in common is
    counted once. A set that resembles neither is counted in full.
    """
    g = len(sets)
    own = np.repeat(np.arange(g), [len(x) for x in sets])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(item, kind="stable")
    holders, ends = own[order], np.cumsum(np.bincount(item))
    starts = ends - np.bincount(item)
    parts = np.split(item, np.cumsum([len(x) for x in sets])[:-1])

    def held(items: np.ndarray) -> np.ndarray:
        count = ends[items] - starts[items]
        at = np.repeat(starts[items] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(holders[at], minlength=g)

    weight = np.bincount(own, weights=(ends - starts)[item], minlength=g)
    hub = int(weight.argmax())
    answers = held(parts[hub])
    known = {hub: answers}
    yield hub, answers
    size = np.array([len(x) for x in sets])
    near = np.argsort(-(answers / np.maximum(size + size[hub] - answers, 1)), kind="stable")
    last = hub
    for k in near.tolist():
        if k == hub:
            continue
        base, change = None, len(parts[k])
        for other in {hub, last}:
            differ = size[k] + size[other] - 2 * int(known[other][k])
            if differ < change:
                base, change = other, differ
        if base is None:
            answers = held(parts[k])
        else:
            more, less = np.setdiff1d(parts[k], parts[base], assume_unique=True), np.setdiff1d(parts[base], parts[k], assume_unique=True)
            answers = known[base] + held(more) - held(less)
        known = {hub: known[hub], k: answers}
        last = k
        yield k, answers


def _cluster_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forests (a, b) of the links within clusters, from rows (cluster, x, y, doc, block, items) in order of the first three.

    Of two blocks, only links between them count.
    """
    rest = None

    def solve(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sets = [_unpacked(x) for x in pdf["items"]]
        doc, block = pdf["doc"].to_numpy(), pdf["block"].to_numpy()
        n = np.array([len(s) for s in sets], np.int64)
        apart = block.min() != block.max() or pdf["x"].iloc[0] != pdf["y"].iloc[0]
        forest = Forest(len(sets))
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            found = [(0, np.array([0, both]))]
        else:
            found = overlaps(sets)
        for k, both in found:
            linked = 100 * both >= PERCENT * (n[k] + n - both)
            linked[k] = False
            if apart:
                linked &= block != block[k]
            other = np.flatnonzero(linked)
            if len(other):
                forest.add(np.full(len(other), k), other)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return doc[edges[:, 0]], doc[edges[:, 1]]

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[["cluster", "x", "y"]].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        got = [solve(pdf.iloc[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i + 1]
        a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        open_ = (pdf[["cluster", "x", "y"]].to_numpy() == pdf[["cluster", "x", "y"]].to_numpy()[-1]).all(1)
        rest = pdf[open_].reset_index(drop=True)
        if (~open_).any():
            yield runs(pdf[~open_].reset_index(drop=True))
    if rest is not None and len(rest):
        yield runs(rest)


def _clusters(lists: DataFrame) -> DataFrame:
    """(doc, cluster): each document of the index lists (token, doc, n, pos, size) with a document that it probably resembles.

    The hub of a list is the entry that meets most others over all its lists: of near copies, the text they were made from.
    A document goes to the hub of most of its lists, if that is a tenth of its prefix, and on to that one's hub. Clusters only
    decide where sets are compared, never whether.
    """
    degree = lists.groupBy("doc").agg(F.sum(F.col("size") - 1).alias("degree"))
    met = lists.select("token", "doc", "n").join(_small(materialize(degree)), "doc")
    hubs = materialize(met.groupBy("token").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("hub")))
    votes = lists.select("token", "doc", "n").join(hubs, "token").groupBy("doc", "n", "hub").agg(F.count(F.lit(1)).alias("votes"))
    enough = F.expr(f"10 * votes >= n - ceil({PERCENT} * n / 100.0) + 1")
    best = votes.groupBy("doc", "n").agg(F.max_by(F.when(enough, F.col("hub")).otherwise(F.col("doc")), F.struct("votes", -F.col("hub"))).alias("hub"))
    best = materialize(best)
    onward = best.select(F.col("doc").alias("hub"), F.col("hub").alias("cluster"))
    return materialize(best.join(onward, "hub").select("doc", "n", "cluster"))


def _within_clusters(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges (a, b) that span the links between documents of the same cluster; large clusters are compared block by block."""
    cut = F.greatest(F.ceil(F.col("size") / CLUSTER_BLOCK), F.ceil(8 * F.col("items") / CLUSTER_BYTES)).cast("long")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items")).where("size > 1").select("cluster", cut.alias("blocks"))
    sizes = materialize(sizes)  # so that the join deals clusters out again, and Spark may split a large one
    members = materialize(clusters.select("doc", "cluster").join(sizes, "cluster"))
    sets = _packed(docs, members.select(F.col("doc").alias("doc_id")))
    placed = sets.join(_small(members), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = pairs.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc", "block", "items")
    keys = ["cluster", "x", "y"]
    return materialize(rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_cluster_links, "a long, b long"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that link. Each document in them is read once; sets meet in a join that Spark may split."""
    pairs = materialize(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(_packed(docs, materialize(ids)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last, hub = [], None, None
            for a, x, y in zip(pdf["a"], pdf["items_a"], pdf["items_b"], strict=True):
                if a != last:
                    last, hub = a, _unpacked(x)
                other = _unpacked(y)
                both = len(np.intersect1d(hub, other, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(hub) + len(other) - both))
            yield pdf.loc[keep, ["a", "b"]]

    members = pairs.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("items_b")), "b")
    hubs = sets.select(F.col("doc").alias("a"), F.col("items").alias("items_a"))
    return materialize(members.join(hubs, "a").select("a", "b", "items_a", "items_b").mapInPandas(compare, "a long, b long"))


def _blocks(n: np.ndarray, pos: np.ndarray, group: np.ndarray, cluster: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one index list, of different groups, clusters and (where given) sides, whose sizes and positions allow a link.

    The list is in order of size. Two blocks are skipped together where their extreme sizes, or the most that can still
    be shared after the positions of this shingle, rule out every pair.
    """
    left = n - pos - 1
    edges = range(0, len(n), BLOCK)
    stats = [(n[k : k + BLOCK].min(), n[k : k + BLOCK].max(), pos[k : k + BLOCK].max(), left[k : k + BLOCK].max()) for k in edges]
    for y, (low_y, _, pos_y, left_y) in enumerate(stats):
        for x in range(y + 1):
            low_x, high_x, pos_x, left_x = stats[x]
            if 100 * high_x < PERCENT * low_y or min(pos_x, pos_y) + 1 + min(left_x, left_y) < required(low_x, low_y):
                continue
            a, b = np.arange(x * BLOCK, min(len(n), (x + 1) * BLOCK))[:, None], np.arange(y * BLOCK, min(len(n), (y + 1) * BLOCK))[None, :]
            most = np.minimum(pos[a], pos[b]) + 1 + np.minimum(left[a], left[b])
            ok = (a < b) & (group[a] != group[b]) & (cluster[a] != cluster[b]) & (100 * n[a] >= PERCENT * n[b]) & (most >= required(n[a], n[b]))
            if side is not None:
                ok &= side[a] != side[b]
            i, j = np.nonzero(ok)
            if len(i):
                yield i + x * BLOCK, j + y * BLOCK


def _cross_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of shared prefix shingles of pairs (a, b) of different groups and clusters, from rows in order of token, x, y, size and
    document. x and y are the parts of a long list that meet; of two parts, only pairs between them count."""
    names, keys = ["a", "b", "n_a", "n_b", "shared"], ["token", "x", "y"]
    held, total, rest = [], 0, None

    def flush() -> pd.DataFrame:
        all_ = pd.DataFrame(np.concatenate(held) if held else np.empty((0, 4), np.int64), columns=names[:4])
        return all_.groupby(names[:4], sort=False).size().rename("shared").reset_index()

    def lists(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        key = pdf[keys].to_numpy()
        doc, n, pos, group, cluster, side = (pdf[c].to_numpy().astype(np.int64) for c in ("doc", "n", "pos", "grp", "cluster", "side"))
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for x, y in _blocks(n[i:j], pos[i:j], group[i:j], cluster[i:j], side[i:j] if key[i, 1] != key[i, 2] else None):
                a, b = doc[i:j][x], doc[i:j][y]
                swap = a > b
                yield np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n[i:j][y], n[i:j][x]), np.where(swap, n[i:j][x], n[i:j][y])], 1)

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        open_ = (pdf[keys].to_numpy() == pdf[keys].to_numpy()[-1]).all(1) if len(pdf) else np.empty(0, bool)
        rest = pdf[open_]
        for got in lists(pdf[~open_]) if (~open_).any() else ():
            held.append(got)
            total += len(got)
            if total > 2_000_000:
                yield flush()
                held, total = [], 0
    if rest is not None and len(rest):
        held += list(lists(rest))
    yield flush()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of (doc_id, text) under links of Jaccard >= PERCENT / 100.

    1. Equal sets (size and 128-bit digest) are one set. 2. Each set's prefix goes into index lists by shingle; lists of one
    entry vanish. 3. Sets that share many lists with the same hub form a cluster, whose links are all worked out together.
    4. Within each list only sets of different groups and clusters are paired, as the answers for others are known, blocks being
    skipped by position; the exact count of shared prefix shingles bounds the intersection, and what passes is compared in
    full. So a group of near copies is never written out as pairs, and no link is lost. Frequent shingles come last in the
    order, so no list holds all documents of a stock phrase; a list that is long all the same is cut into parts, and each two
    parts are a task.

    A null text, or one without words, has an empty set and links with nothing. Null ids keep null components. Extra columns
    are ignored; rows that repeat a doc_id must repeat its text.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    seen = materialize(survey(docs))
    sizes = seen.where("n is not null").select("doc_id", "n", "h1", "h2")
    same = sizes.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"))
    same = materialize(same)
    copies = materialize(sizes.join(same, ["h1", "h2", "n"]).where("doc_id <> first").select("doc_id", "first").distinct())
    often = (
        seen.where("n is null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LEAST_FREQUENT)
        .orderBy(F.desc("seen"), "token").limit(MAX_FREQUENT).toPandas()
    )
    token = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    frequent = (token[order], np.minimum(often["seen"].to_numpy(np.int64), 1 << 40)[order])
    rows = prefix_rows(docs.where("doc_id is not null").join(copies.select("doc_id"), "doc_id", "left_anti"), frequent)
    lists = materialize(rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("size > 1"))
    release(spark)
    clusters = _clusters(lists)
    sure = _within_clusters(docs, clusters)
    release(spark)
    known = components(sure).select(F.col("node").alias("doc"), F.col("component_id").alias("grp"))
    state = materialize(clusters.join(known, "doc", "left").select("doc", "cluster", F.coalesce("grp", "doc").alias("grp")))
    grouped = materialize(lists.select("token", "doc", "n", "pos", "size").join(_small(state), "doc"))
    ends = [f(c).alias(f"{k}_{c}") for c in ("grp", "cluster") for k, f in (("low", F.min), ("high", F.max))]
    mixed = grouped.groupBy("token").agg(*ends).where("low_grp <> high_grp and low_cluster <> high_cluster").select("token")
    open_ = grouped.join(_small(materialize(mixed)), "token").withColumn("parts", F.ceil(F.col("size") / LIST_BLOCK))
    open_ = open_.withColumn("side", F.pmod(F.xxhash64("doc"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    open_ = open_.select("token", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "n", "doc", "pos", "grp", "cluster", "side")
    open_ = open_.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "doc")
    pairs = open_.mapInPandas(_cross_pairs, "a long, b long, n_a long, n_b long, shared long")
    total = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    rest = F.greatest(*[F.expr(f"cast(ceil({PERCENT} * {n} / 100.0) as bigint) - 1") for n in ("n_a", "n_b")])
    need = F.expr(f"cast(ceil({PERCENT} * (n_a + n_b) / {100 + PERCENT}.0) as bigint)")
    more = _verified(docs, total.where(F.col("shared") + rest >= need).select("a", "b"))
    edges = sure.union(more).union(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    found = components(edges)
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
