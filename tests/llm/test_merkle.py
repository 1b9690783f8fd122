"""The Merkle manifest against a plain recursion over sorted lists."""

import hashlib
import random
import zlib

import pytest

from palmleaf.llm import merkle

from . import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, block string, proof string, c0 string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """The root over nodes, and of each the sibling runs on its way: [(left, right), ...]."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for path, w in zip(paths, where, strict=True):
            run, at = runs[w // 8], w % 8
            path.append((run[:at], run[at + 1 :]))
        where = [w // 8 for w in where]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([t[2] for t in sorted(by[x], key=lambda t: t[:3])]) for x in langs}
    root, above = climb([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above, strict=True):
        for (_, _, own, (doc, text, lang, source, n)), path in zip(sorted(by[x], key=lambda t: t[:3]), trees[x][1], strict=True):
            struck = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if struck else text
            node = leaf(doc, source, lang, n, small)
            for left, right in path + up:
                node = h(*left, node, *right)
            out.append((doc, own, trees[x][0], root, h(*(s for left, right in path + up for s in left + right)), node, node == root))
    return sorted(out, key=str)


def rows(n, langs, seed=3):
    r = random.Random(seed)
    return [(k, r.choice([None, "", "A b", f"Ärger {k}", f"plain {k}", "Q" * 3000]), r.choice(langs), r.choice([None, "s"]), r.choice([None, k])) for k in range(n)]


def frame(spark, items):
    return spark.createDataFrame([(*r, "old", "old", "old", "old", "old") for r in items], SCHEMA)


@pytest.mark.parametrize("levels", [None, 1, 2])
@pytest.mark.parametrize(
    "items",
    [
        rows(700, [None, "", "a", "b", "ß", "zz"]), rows(65, ["a"]), rows(64, ["a"]), rows(1, [None]), rows(9, ["a", "b"]), rows(40, [f"l{k}" for k in range(30)]),
        [(None, "A", "a", None, 1), (None, "B", "a", None, 1), (7, "A", "a", "s", 1), (7, "A", "a", "s", 1), (7, "b", "a", "s", 1), (8, "C", None, "s", 1)] + [(3, "Same", "a", "s", 4)] * 100,
    ],
)
def test_manifest(spark, monkeypatch, items, levels):
    if levels:
        manifest = merkle.manifest
        monkeypatch.setattr(merkle, "manifest", lambda *a: manifest(*a, block_levels=levels))
        monkeypatch.setattr(merkle, "PROOFS", 5)
    got = sorted((tuple(r) for r in merkle.document_proofs(frame(spark, items)).collect()), key=str)
    assert got == plain(items)


def test_edges(spark, monkeypatch):
    assert merkle.document_proofs(corpus.empty(spark)).count() == 0
    df = frame(spark, rows(20, ["a", None])).withColumn("leaf", merkle.leaf_hash(merkle.F.col("text")))
    got = merkle.manifest(df, "lang", ["doc_id"])
    # columns named like those used inside pass, those named like new ones are replaced
    assert got.columns == [c for c in df.columns if c != "proof"] + ["subroot", "root", "proof"]
    assert all(r["tree"] == "old" and r["c0"] == "old" and r["proof"] for r in got.collect())
    monkeypatch.setattr(merkle, "MOST_NODES", 1)
    with pytest.raises(ValueError, match="broadcast"):
        merkle.manifest(df, "lang", ["doc_id"])


def test_places(spark):
    """Places are gapless within a tree, in order, with a third of all rows in equal rows."""
    items = [(k % 50, "t") for k in range(400)] + [(7, "t")] * 200
    df = spark.createDataFrame(items, "doc_id long, tree string").repartition(7)
    got = merkle.placed(df, ["doc_id"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(600)) and {r["size"] for r in got} == {600}
    assert [r["doc_id"] for r in got] == sorted(k for k, _ in items)
