"""Merkle manifest of a table: blocks are reduced on the executors, the driver builds the small top, proofs are finished beside it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

FANOUT = 8
#: Levels of a block: the fewest from here on that leave at most TOP_NODES blocks, and never more than the second number.
BLOCK_LEVELS, TOP_NODES = (4, 6), 1 << 16
#: Most nodes that the driver builds the top from and broadcasts (32 bytes each); more are refused.
MOST_NODES = 1 << 20
#: Rows whose proofs are in memory at once.
PROOFS = 4096
_STEP = "array<struct<left:binary,right:binary>>"


def digest(parts: Sequence[bytes]) -> bytes:
    """The node over `parts`: sha256 of their hex texts, one behind the other."""
    return sha256(b"".join(parts).hex().encode()).digest()


def parents(nodes: Sequence[bytes]) -> list[bytes]:
    """One node for every FANOUT successive ones; the last run may be shorter, even one."""
    return [digest(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)]


def depth(n: int) -> int:
    """How many levels reduce n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def reduce_levels(nodes: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """`nodes` and the `levels` levels above them."""
    out = [list(nodes)]
    for _ in range(levels):
        out.append(parents(out[-1]))
    return out


def steps(tree: list[list[bytes]], place: int) -> list[tuple[bytes, bytes]]:
    """The siblings of the node at `place` of the lowest level, left and right of it, for every level but the last one."""
    out = []
    for level in tree[:-1]:
        a = place - place % FANOUT
        out.append((b"".join(level[a:place]), b"".join(level[place + 1 : a + FANOUT])))
        place //= FANOUT
    return out


def leaf_hash(*fields: Column) -> Column:
    """sha256 (binary) of the fields: `-` for a null, else the UTF-8 length in bytes, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """`leaves` with `place` (from 0) within their `tree` and `size`, the number of leaves there; rows are numbered by `order`.

    The rows are dealt into ranges of (tree, order), sorted and numbered there; the counts of each range, a row for each range
    and tree, are summed up to say where a range begins. No tree, however large, is one task's. Equal rows are told apart
    by a number they got beforehand, so a third of all rows may be equal.
    """
    unique, number = fresh(leaves, "unique"), fresh(leaves, "number")
    marked = materialize(leaves.withColumn(unique, F.monotonically_increasing_id()))
    by = ["tree", *order, unique]
    dealt = materialize(marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(number, F.monotonically_increasing_id()).drop(unique))
    part = F.shiftright(number, 33)
    ranges = dealt.groupBy("tree", part.alias("part")).agg(F.min(number).alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    ranges = materialize(ranges.select(F.col("tree").alias("tree_"), "part", "low", "begin", "size"))
    return dealt.join(ranges, (part == F.col("part")) & (F.col("tree") == F.col("tree_"))).select(
        *[F.col(f"`{c}`") for c in leaves.columns], (F.col(number) - F.col("low") + F.col("begin")).alias("place"), "size"
    )


def manifest(rows: DataFrame, tree: str, order: Sequence[str], leaf: str = "leaf", block_levels: int | None = None) -> DataFrame:
    """Add to every row its proof: `subroot`, `root` (binary) and `proof`, the siblings left and right of its path, level by level
    from the leaf to the root.

    `leaf` is a binary digest; rows with equal `tree` (a null is one too) form a tree, in ascending `order` (nulls first, then by the
    leaf). While a tree has several nodes, every FANOUT successive ones become their parent. The trees' subroots, ordered by `tree`
    (null first, bytes of UTF-8), likewise give the root. A lone leaf is its tree's subroot, a lone subroot the root.

    Blocks of FANOUT ** block_levels leaves are reduced in a task each. The driver gets a node a block and the trees' sizes, builds
    what is above, and broadcasts it; then every block is gone through again and its rows' proofs are finished with the top's siblings.
    Blocks grow until few are left, so the top has at most TOP_NODES nodes and one for each tree, or one for each FANOUT ** 6 leaves.
    More than MOST_NODES trees and blocks are refused with a ValueError. Other columns pass; those named like new ones are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("subroot", "root", "proof")
    # inside, columns go by number, so that no name clashes with those used here
    inner = {c: f"c{k}" for k, c in enumerate(rows.columns)}
    leaf = inner[leaf]
    # a null tree sorts before all others, an empty name among them
    key = F.col(inner[tree])
    named = rows.toDF(*inner.values()).withColumn("tree", F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), key.cast("string"))))
    leaves = materialize(placed(named, [*(inner[c] for c in order), leaf]))
    sizes = {r["tree"]: r["n"] for r in leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).limit(MOST_NODES + 1).collect()}
    blocks = lambda k: sum(-(-n // FANOUT**k) for n in sizes.values())
    levels = block_levels or next((k for k in range(BLOCK_LEVELS[0], BLOCK_LEVELS[1]) if blocks(k) <= TOP_NODES), BLOCK_LEVELS[1])
    if blocks(levels) > MOST_NODES:
        raise ValueError(f"{blocks(levels)} trees and blocks are more than the {MOST_NODES} that may be broadcast")
    dealt = leaves.withColumn("block", F.shiftright("place", 3 * levels))
    own = dealt.select("tree", "block", "place", "size", F.col(leaf).alias("leaf"))

    def block_tree(table: pa.Table, column: str) -> tuple[np.ndarray, list[list[bytes]]]:
        """The rows by place, and the block's levels: to a single node where the block is the whole tree, else all `levels`."""
        order = table.column("place").to_numpy().argsort(kind="stable")
        nodes = table.column(column).combine_chunks().take(pa.array(order)).to_pylist()
        return order, reduce_levels(nodes, min(levels, depth(table.column("size")[0].as_py())))

    def top(table: pa.Table) -> pa.Table:
        _, tree_levels = block_tree(table, "leaf")
        return pa.table({"tree": table.column("tree")[:1], "block": table.column("block")[:1], "node": pa.array([tree_levels[-1][0]], pa.binary())})

    roots = own.groupBy("tree", "block").applyInArrow(top, "tree string, block long, node binary").collect()
    upper: dict[str, list[bytes]] = {}
    for r in sorted(roots, key=lambda r: (r["tree"].encode(), r["block"])):
        upper.setdefault(r["tree"], []).append(bytes(r["node"]))
    trees = {t: reduce_levels(nodes, depth(len(nodes))) for t, nodes in upper.items()}
    summit = reduce_levels([t[-1][0] for t in trees.values()], depth(len(trees)))
    shared = spark.sparkContext.broadcast((trees, {t: k for k, t in enumerate(trees)}, summit))
    kind = pa.struct([("left", pa.binary()), ("right", pa.binary())])
    names = dealt.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        trees_, number, summit_ = shared.value
        tree_, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
        suffix = steps(trees_[tree_], block) + steps(summit_, number[tree_])
        order, tree_levels = block_tree(table, leaf)
        for k in range(0, len(order), PROOFS):
            part = table.take(pa.array(order[k : k + PROOFS])).select(names).combine_chunks().to_batches()[0]
            left, right, ends = [], [], [0]
            for place in range(k, k + part.num_rows):
                for a, b in (*steps(tree_levels, place), *suffix):
                    left.append(a)
                    right.append(b)
                ends.append(len(left))
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], fields=list(kind))
            new = {
                "subroot": pa.array([trees_[tree_][-1][0]] * part.num_rows, pa.binary()), "root": pa.array([summit_[-1][0]] * part.num_rows, pa.binary()),
                "proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
            }
            yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "subroot binary", "root binary", f"proof {_STEP}"])
    done = dealt.groupBy("tree", "block").applyInArrow(finish, schema)
    return done.select(*[F.col(x).alias(c) for c, x in inner.items()], "subroot", "root", "proof")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (binary) and its siblings give, as hex text."""
    return F.aggregate(proof, _hex(leaf), lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings' hex texts, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))), 256)


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, a tree for each lang.

    A leaf covers doc_id, source, lang, n_chars and text. folded_root is folded from the leaf as it is after tampering: where 3
    divides crc32 of the id, the text's A-Z are lower-cased; a null id isn't tampered with and comes first in its tree. Documents
    with one doc_id follow each other by their leaves; fully equal ones have neighbouring places and each a proof. Extra columns
    are ignored; an empty table gives no rows.
    """
    hashed = lambda text: leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "lang", hashed(F.col("text")).alias("leaf"), F.when(struck, hashed(lower)).alias("altered"))
    root = _hex(F.col("root"))
    done = manifest(rows, "lang", ["doc_id"]).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return done.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
