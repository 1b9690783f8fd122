"""Byte-exact repeated substrings: sparse enhanced suffix arrays over content-chosen anchors, and their interval trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, release
from .shingles import mix, powers, prefix_hash

#: Bytes of the shortest repeat, and of an anchor. Every window of LEAST bytes owns its smallest anchor.
LEAST, ANCHOR = 100, 32
_SPREAD = LEAST - ANCHOR + 1
#: An anchor with more different surroundings than this is resolved window by window, with counts that combine map-side.
LIMIT = 4096
#: Anchors are counted over one of so many documents beforehand; one that promises more than LIMIT occurrences is dealt out in parts.
PROBE = 16
#: Most ids that are broadcast; beyond it Spark joins by shuffling.
MAX_BROADCAST_IDS = 500_000
_SLICE, _STRETCH = 1 << 19, 250_000


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width`."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first window, last window, anchor hash, hash of the windows' bytes) of each anchor.

    Positions count in the text. The windows from first to last are those whose smallest hash of ANCHOR bytes, the
    leftmost of equals, is the anchor's; so equal windows own equal anchors at equal places, whatever is around them.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LEAST:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    total = prefix_hash(data)
    _, down = powers(len(data) + 1)
    gram = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: len(total) - ANCHOR])
    least = _smallest(gram, _SPREAD)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    step = np.zeros(len(least) + 1, np.int32)
    long = sizes >= LEAST
    np.add.at(step, begins[long], 1)
    np.add.at(step, ends[long] - LEAST + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    same = np.zeros(len(least) + 1, bool)
    same[1:-1] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1]
    # windows of neighbouring long texts never touch: the last LEAST - 1 starts of a text are not valid
    first, last = np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:])
    entered = np.zeros(len(first), bool)
    inner = first > 0
    entered[inner] = valid[first[inner] - 1] & (least[first[inner]] < least[first[inner] - 1])
    out = []
    at = first + _SPREAD - 1
    look = np.flatnonzero(~entered)
    span = np.arange(_SPREAD)
    for k in range(0, len(look), 4096):
        pick = look[k : k + 4096]
        at[pick] = first[pick] + gram[first[pick][:, None] + span].argmin(1)
    while len(first):
        out.append((first, np.minimum(last, at), at))
        more = np.flatnonzero(at < last)  # the same hash again within the run
        first, last = at[more] + 1, last[more]
        at = first + gram[first[:, None] + span].argmin(1) if len(first) else first
    first, last, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (first, last, at)
    own = np.searchsorted(ends, first, "right")
    code = (total[last + LEAST] - total[first]) * down[first] + mix(((at - first) << 8 | (last - first)).astype(np.uint64))
    base = begins[own]
    return own, at - base, first - base, last - base, gram[at], mix(code)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc_ids, texts as bytes) of about _SLICE bytes at a time, from columns doc_id and text without nulls."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    texts, at, held = [], 0, 0
    for k, text in enumerate(batch.column(1).cast(pa.binary())):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= _SLICE:
            yield ids[at : k + 1], texts
            texts, at, held = [], k + 1, 0
    if texts:
        yield ids[at:], texts


def _batch(pdf: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pdf, schema, preserve_index=False)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(kind, anchor, code, doc, at, back, fore): kind 0, the first of equal anchors with equal surroundings in a stretch of
    the corpus; kind 1, the others, which are repeats for certain, under a key of their own. Bytes at - back .. at + fore are meant."""

    schema = pa.schema(
        [("kind", pa.int8()), *((c, pa.int64()) for c in ("anchor", "code", "doc", "at")), ("back", pa.int16()), ("fore", pa.int16())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            doc, at, first, last, anchor, code = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc, code, anchor))
            doc, at, first, last, anchor, code = (x[order] for x in (doc, at, first, last, anchor, code))
            again = np.zeros(len(doc), np.int8)
            again[1:] = (anchor[1:] == anchor[:-1]) & (code[1:] == code[:-1])
            alone = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
            rows = pd.DataFrame(
                {
                    "kind": again, "anchor": np.where(again, alone, anchor).view(np.int64), "code": code.view(np.int64), "doc": doc, "at": at,
                    "back": (at - first).astype(np.int16), "fore": (last + LEAST - at).astype(np.int16),
                }
            )
            return _batch(rows, schema)

        for batch in batches:
            for ids, texts in _slices(batch):
                own, at, first, last, anchor, code = anchors(texts)
                held.append((ids[own], at, first, last, anchor, code))
                total += len(own)
                if total >= _STRETCH:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "kind byte, anchor long, code long, doc long, at long, back short, fore short")


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that rows of x and y have in common from the start, at most `most`."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 1 << 16):
        unlike = x[k : k + (1 << 16)] != y[k : k + (1 << 16)]
        out[k : k + (1 << 16)] = np.where(unlike.any(1), unlike.argmax(1), x.shape[1])
    return np.minimum(out, most)


def _order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The suffix array of each group: row numbers by group, then by the rows' bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort((*words.T[::-1], group))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every node of the common-prefix interval tree with two leaves or more, children first.

    lcp[i] is what entry i has in common with entry i - 1 (below 0 at a border); a stack holds the open intervals.
    """
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp, -1]):
        left = i - 1
        while stack and stack[-1][0] > h:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, left))


def repeat_groups(list_no: np.ndarray, doc: np.ndarray, at: np.ndarray, back: np.ndarray, spans: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, entries) of each maximal repeat of LEAST bytes or more that contains the anchor of an anchor list.

    Entries of a list are sorted by what follows their anchor; each node of that array's interval tree is a common right
    extension. Within a node, the entries are sorted by what precedes, and a second stack scan finds the left extensions
    that, with the right one, are long enough. Such a node of the second tree has different bytes before its entries (or a border),
    so it extends neither way: a maximal repeat, with all its occurrences.
    """
    n = len(doc)
    size = np.array([len(s) for s in spans], np.int64)
    flat = np.frombuffer(b"".join(spans), np.uint8)
    mid = np.cumsum(size) - size + back
    after, before = size - back, back
    step = np.arange(LEAST)
    right = np.where(step < after[:, None], flat[np.minimum(mid[:, None] + step, len(flat) - 1)], 0).astype(np.uint8)
    step = np.arange(LEAST - ANCHOR)
    left = np.where(step < before[:, None], flat[np.maximum(mid[:, None] - 1 - step, 0)], 0).astype(np.uint8)
    order = _order(right, list_no)
    a, b = order[:-1], order[1:]
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(list_no[a] == list_no[b], _common(right[a], right[b], np.minimum(after[a], after[b])), -1)
    rank = np.empty(n, np.int64)
    rank[_order(left, list_no)] = np.arange(n)
    pairs, large = [], []
    for depth, i, j in intervals(lcp.tolist()):
        if depth >= ANCHOR:
            (pairs if j == i + 1 else large).append((depth, i, j))
    if pairs:
        depth, i, j = np.array(pairs).T
        a, b = order[i], order[j]
        both = _common(left[a], left[b], np.minimum(before[a], before[b]))
        for k in np.flatnonzero(both + depth >= LEAST).tolist():
            who = np.array([a[k], b[k]])
            yield int(both[k] + depth[k]), at[who] - both[k], who
    for depth, i, j in large:
        who = order[i : j + 1]
        who = who[np.argsort(rank[who])]
        a, b = who[:-1], who[1:]
        both = _common(left[a], left[b], np.minimum(before[a], before[b]))
        both[both + depth < LEAST] = -1
        if depth + both.max() < LEAST:
            continue
        for reach, x, y in intervals([-1, *both.tolist()]):
            some = who[x : y + 1]
            yield depth + reach, at[some] - reach, some


def _union(doc: np.ndarray, start: np.ndarray, finish: np.ndarray) -> pd.DataFrame:
    """The ranges as maximal runs of each document."""
    order = np.lexsort((start, doc))
    doc, start, finish = doc[order], start[order], finish[order]
    _, place = np.unique(doc, return_inverse=True)
    reach = np.maximum.accumulate(place * (1 << 40) + finish)  # positions stay below 2**40
    fresh = np.ones(len(doc), bool)
    fresh[1:] = place[1:] * (1 << 40) + start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
    return pd.DataFrame({"doc": doc[fresh], "start": start[fresh], "finish": reach[last] - place[last] * (1 << 40)})


def _removals_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, start, finish) to remove, from rows (anchor, doc, at, back, span) in order of anchor."""
    rest = None

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        _, list_no = np.unique(pdf["anchor"].to_numpy(), return_inverse=True)
        doc, at = pdf["doc"].to_numpy(), pdf["at"].to_numpy()
        place = np.empty(len(doc), np.int64)
        place[np.lexsort((at, doc))] = np.arange(len(doc))
        docs, starts, ends = [], [], []
        for length, begin, who in repeat_groups(list_no, doc, at, pdf["back"].to_numpy().astype(np.int64), pdf["span"].tolist()):
            later = place[who] != place[who].min()
            docs.append(doc[who[later]])
            starts.append(begin[later])
            ends.append(begin[later] + length)
        if not docs:
            return pd.DataFrame({"doc": [], "start": [], "finish": []}, dtype="int64")
        return _union(np.concatenate(docs), np.concatenate(starts), np.concatenate(ends))

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf["anchor"].to_numpy()
        open_ = key == key[-1] if len(key) else np.empty(0, bool)
        rest = pdf[open_].reset_index(drop=True)
        if (~open_).any():
            yield solve(pdf[~open_].reset_index(drop=True))
    if rest is not None and len(rest):
        yield solve(rest)


def _pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with ids (doc_id and more), broadcast only where their number is small."""
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", how)


def frequent_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, parts): anchors that promise more than LIMIT occurrences, by a count over one document of PROBE, and the parts of about LIMIT
    occurrences that they make. What isn't seen here is treated as rare, which changes how it is worked out and not the result."""
    some = anchor_rows(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(PROBE)) == 0)).where("kind = 0")
    counts = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * PROBE > LIMIT)
    return materialize(counts.select("anchor", F.ceil(F.col("n") * PROBE / max(LIMIT, 1)).alias("parts")))


def listed(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of `anchor_rows` that may be repeats, by anchor: n, low and high are its number of rows and its least and greatest code,
    `later` whether one of its rows before this one has the same code. A frequent anchor is dealt out in parts, each for
    itself (`part`, else null), so that no window holds much more than LIMIT rows of one."""
    flagged = rows.join(F.broadcast(hot) if hot.count() <= MAX_BROADCAST_IDS else hot, "anchor", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc", "at"), F.col("parts")))
    by_anchor = Window.partitionBy("kind", "anchor", "part")
    told = flagged.withColumn("part", part).drop("parts").withColumns(
        {
            "n": F.count(F.lit(1)).over(by_anchor), "low": F.min("code").over(by_anchor), "high": F.max("code").over(by_anchor),
            "prev": F.lag("code").over(by_anchor.orderBy("code", "doc", "at")),
        }
    )
    return told.where("kind = 1 or n > 1 or part is not null").withColumn("later", F.coalesce(F.col("prev") == F.col("code"), F.lit(False))).drop("prev")


def removals(docs: DataFrame) -> DataFrame:
    """(doc, start, finish): byte ranges of (doc_id, text) that together are all bytes covered by a string of LEAST bytes that
    starts earlier too (smaller doc_id, or earlier in the same text).

    1. Of documents with equal texts all but the first go whole. 2. Each window of LEAST bytes owns an anchor; anchors meet by
    hash, and those that occur once vanish. 3. Anchors with equal surroundings are classes: all but the first are repeats.
    4. The classes' first members, with their bytes, form a sparse suffix array for each anchor, a prefix bucket of the
    corpus's suffix array; its interval tree gives the maximal repeat groups, and all but a group's first occurrence go.
    5. An anchor with more than LIMIT different surroundings would be one task's list: it is dealt out in parts beforehand, its members'
    windows are hashed instead, and aggregations that combine map-side find the first of each.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    size = F.octet_length("text")
    long = docs.where(size >= LEAST)
    key = long.select("doc_id", size.cast("long").alias("size"), F.md5("text").alias("h"))
    rows = key.groupBy("h", "size", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    first = materialize(
        rows.groupBy("h", "size").agg(F.min(F.struct("doc_id", "c")).alias("least"), F.sum("c").alias("n")).where("n > 1")
        .select("h", "size", F.col("least.doc_id").alias("first"), F.col("least.c").alias("c"))
    )
    copies = materialize(key.join(first, ["h", "size"]).where("doc_id <> first").select("doc_id", "size").distinct())
    whole = copies.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), F.col("size").alias("finish"))
    alone = _pick(long, copies.select("doc_id"), "left_anti")
    # a row that comes again with its id and text starts nowhere earlier than itself: it counts once
    again = first.where("c > 1").select(F.col("first").alias("doc_id")).distinct()
    texts = docs
    if not again.isEmpty():
        once = materialize(_pick(alone, again, "left_semi").dropDuplicates(["doc_id", "text"]))
        texts = alone = _pick(alone, again, "left_anti").union(once)

    hot = frequent_anchors(alone)
    lists = materialize(listed(anchor_rows(alone), hot))
    release(spark)
    sure = lists.where("kind = 1 or later").select("doc", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("fore")).alias("finish"))

    firsts = lists.where("kind = 0 and not later and part is null and low <> high")
    columns = ["anchor", "doc", "at", "back", "fore"]
    out, many = whole.union(sure), firsts.where(f"n > {LIMIT}").select(*columns)
    if not hot.isEmpty():
        # of the parts' firsts the least is the anchor's
        spread = lists.where("kind = 0 and not later and part is not null")
        least = materialize(spread.groupBy("anchor", "code").agg(F.min(F.struct("doc", "at")).alias("first")))
        spread = materialize(spread.join(least, ["anchor", "code"]).withColumn("later", F.struct("doc", "at") > F.col("first")).select("later", *columns))
        out = out.union(spread.where("later").select("doc", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("fore")).alias("finish")))
        many = many.union(spread.where("not later").select(*columns))
    bytes_ = materialize(wanted_bytes(texts, firsts.where(f"n <= {LIMIT}").select(*columns), many))
    release(spark)

    spans = bytes_.where("not each").drop("each")
    found = spans.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_removals_of_lists, "doc long, start long, finish long")
    found = materialize(found)
    release(spark)
    out = out.union(found)

    windows = bytes_.where("each").select(F.col("span").alias("code"), "doc", "at")
    if not windows.isEmpty():
        best = windows.groupBy("code").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("code", "first")
        again = windows.join(materialize(best), "code").where(F.struct("doc", "at") > F.col("first"))
        out = out.union(again.select("doc", F.col("at").alias("start"), (F.col("at") + LEAST).alias("finish")))
    return out


def wanted_bytes(texts: DataFrame, few: DataFrame, many: DataFrame) -> DataFrame:
    """(each, anchor, doc, at, back, span) of the anchors (anchor, doc, at, back, fore), from the texts, which are shuffled once for both kinds: of `few`
    the bytes around each anchor, of `many`, with each set, the digest of every window of LEAST bytes that one owns, which starts at `at`."""
    both = few.withColumn("each", F.lit(False)).union(many.withColumn("each", F.lit(True)))
    wanted = both.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "at", "back", "fore", "each")).alias("w"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["each", "anchor", "doc", "at", "back", "span"]
        for pdf in batches:
            out = []
            for doc, text, w in zip(pdf["doc_id"], pdf["text"], pdf["w"], strict=True):
                data = text.encode()
                for x in w:
                    first, end = x["at"] - x["back"], x["at"] + x["fore"]
                    if x["each"]:
                        out += [(True, x["anchor"], doc, p, 0, hashlib.md5(data[p : p + LEAST]).digest()) for p in range(first, end - LEAST + 1)]
                    else:
                        out.append((False, x["anchor"], doc, x["at"], x["back"], data[first:end]))
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    return texts.join(wanted, "doc_id").mapInPandas(cut, "each boolean, anchor long, doc long, at long, back short, span binary")


def merged(ranges) -> list[tuple[int, int]]:
    """The union of (start, finish) ranges as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for start, finish in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(finish, out[-1][1]))
        else:
            out.append((start, finish))
    return out


def dedup_substrings(docs: DataFrame, spans_col: str = "removed", kept_col: str = "kept") -> DataFrame:
    """Add the removed byte ranges of each text (`spans_col`, maximal runs in order) and the bytes that are left (`kept_col`).

    A null text counts as empty and a null doc_id as a document without repeats. doc_id should be unique; rows that repeat one
    get the ranges found under it. Texts below LEAST bytes lose nothing. Extra columns pass through, those named like the
    new ones are replaced.
    """
    docs = docs.drop(spans_col, kept_col)
    name, new = fresh(docs, "gone"), fresh(docs, "new")
    gone = removals(docs).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("start", "finish")).alias(name))
    both = docs.join(gone, "doc_id", "left")

    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for text, gone in zip(texts, ranges, strict=True):
            data = text.encode()
            runs = [(a, min(b, len(data))) for a, b in merged((x["start"], x["finish"]) for x in gone) if a < len(data)]
            parts, at = [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            spans.append([{"start": a, "finish": b} for a, b in runs])
            kept.append(b"".join(parts) + data[at:])
        return pd.DataFrame({"spans": spans, "kept": kept})

    fix = F.pandas_udf(cut, "spans array<struct<start:bigint,finish:bigint>>, kept binary")
    none = F.array().cast("array<struct<start:bigint,finish:bigint>>")
    hit = F.col(name).isNotNull()
    done = both.withColumn(new, fix(F.when(hit, F.coalesce("text", F.lit(""))).otherwise(F.lit("")), F.coalesce(name, none)))
    return done.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(hit, F.col(f"{new}.spans")).otherwise(none).alias(spans_col),
        F.when(hit, F.col(f"{new}.kept")).otherwise(F.coalesce("text", F.lit("")).cast("binary")).alias(kept_col),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, through `dedup_substrings`."""
    return dedup_substrings(docs.select("doc_id", "text")).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["finish"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
