"""Substring de-duplication by line or paragraph hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A run of successive repeated units goes where, grown, it has this many words; shorter ones are stock phrases, not passages.
#: A run of fewer than SEED_WORDS words isn't grown, and on either side it grows by no more than GROW_WORDS words.
LEAST_WORDS, SEED_WORDS, GROW_WORDS = 40, 8, 200
#: Most ids of documents that are broadcast; beyond that Spark shuffles.
MAX_BROADCAST_IDS = 1 << 21
# Where a unit ends: after the match. A line ends at a line break and, as passages are pasted into lines of any width, at a
# sentence's end too; a paragraph ends at an empty line.
_BLANK = r"[ \t\n\x0b\f\r]"
_CUT = {"line": rf"[.!?]{_BLANK}+|\n{_BLANK}*", "paragraph": rf"\n[ \t]*\n{_BLANK}*"}
_WORD = re.compile(rf"[^ \t\n\x0b\f\r]+{_BLANK}*")
_RUN = "doc_id long, first int, last int, words int, source long, before int, after int"
_FLUSH = 50_000
_SPANS = "array<struct<start:bigint,finish:bigint>>"


def cuts(text: str | bytes, unit: str = "line") -> list[int]:
    """Where the units of `text` end; they cover it without a gap, each with the blanks behind it."""
    pattern = _CUT[unit]
    return [m.end() for m in re.finditer(pattern.encode() if isinstance(text, bytes) else pattern, text)] + [len(text)]


def unit_table(docs: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, no, words, ends, digest) of each unit that isn't blank; units count from 0.

    The digest is the MD5 of the normal form: lower case, white space collapsed to single blanks, none at the ends. `ends` is 1 for a
    text's first such unit, 2 for its last, 3 for its only one, else 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("words", pa.int32()), ("ends", pa.int32()), ("digest", pa.binary())])
    names = list(schema.names)

    def rows_of(doc: int, data: bytes) -> list[list]:
        rows, at = [], 0
        for no, end in enumerate(cuts(data, unit)):
            parts = data[at:end].split()
            at = end
            if parts:
                rows.append([doc, no, len(parts), 0, hashlib.md5(b" ".join(parts)).digest()])
        if rows:
            rows[0][3] += 1
            rows[-1][3] += 2
        return rows

    def packed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += rows_of(doc, text.as_py().lower().encode())
                while len(rows) >= _FLUSH:
                    yield packed(rows[:_FLUSH])
                    rows = rows[_FLUSH:]
        if rows:
            yield packed(rows)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, no int, words int, ends int, digest binary")


def runs_of(units: list) -> list[tuple]:
    """The runs of successive numbers in `units` (no, words, ends, first), by no: (first, last, words, source, before, after).

    Source is the document of the first occurrence of the run's longest unit, the first of equals; before and after are the
    units there that stand where the run's neighbours stand here, -1 where the run has none.
    """
    out, k = [], 0
    while k < len(units):
        j = k
        while j + 1 < len(units) and units[j + 1]["no"] == units[j]["no"] + 1:
            j += 1
        top = max(units[k : j + 1], key=lambda u: (u["words"], -u["no"]))
        shift = top["first"]["no"] - top["no"]
        before = -1 if units[k]["ends"] & 1 else max(units[k]["no"] + shift - 1, -1)
        after = -1 if units[j]["ends"] & 2 else units[j]["no"] + shift + 1
        out.append((units[k]["no"], units[j]["no"], sum(u["words"] for u in units[k : j + 1]), top["first"]["doc_id"], before, after))
        k = j + 1
    return out


def repeated_runs(docs: DataFrame, unit: str, seed_words: int) -> DataFrame:
    """The runs (`_RUN`) of `seed_words` words or more of units that an earlier one (doc_id, then position) repeats.

    Digests are counted and their first places found by an aggregation that combines map-side; the members of repeated
    digests then meet that one row in a join whose large keys Spark may split. What is gathered is a document's own units.
    """
    units = materialize(unit_table(docs, unit))
    first = materialize(
        units.groupBy("digest").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    again = units.join(first, "digest").where(F.struct("doc_id", "no") > F.col("first"))
    # rows that repeat a doc_id may name a unit twice
    found = again.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("no", "words", "ends", "first"))).alias("units"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, units in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = {u["no"]: u for u in reversed(units.as_py())}
                rows += [(doc, *r) for r in runs_of([one[no] for no in sorted(one)]) if r[2] >= seed_words]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _RUN.split(", ")])

    return materialize(found.mapInArrow(cut, _RUN))


def word_prints(text: str, back: bool, most: int) -> list[bytes]:
    """Eight bytes of a hash of each of the first `most` words of a unit, or, last one first, of its last."""
    words = text.lower().encode().split()
    return [hashlib.blake2b(w, digest_size=8).digest() for w in (words[::-1] if back else words)[:most]]


def _edges(docs: DataFrame, runs: DataFrame, unit: str, grow_words: int) -> DataFrame:
    """(source, no, back, prints): the words next to the runs' first occurrences, as hashes, one row for each place and side."""
    sides = F.explode(F.array(F.struct(F.col("before").alias("no"), F.lit(True).alias("back")), F.struct(F.col("after").alias("no"), F.lit(False).alias("back"))))
    places = runs.select(F.col("source").alias("doc_id"), sides.alias("p")).where("p.no >= 0").distinct()
    wanted = materialize(places.groupBy("doc_id").agg(F.collect_list("p").alias("places")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                ends = [0, *cuts(text, unit)]
                rows += [(doc, p["no"], p["back"], b"".join(word_prints(text[ends[p["no"]] : ends[p["no"] + 1]], p["back"], grow_words))) for p in places if p["no"] + 1 < len(ends)]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["source", "no", "back", "prints"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # few documents are first occurrences, so few texts need to be dealt out by their id
    if wanted.count() <= MAX_BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    texts = texts.join(wanted, "doc_id")
    edges = texts.mapInArrow(read, "source long, no int, back boolean, prints binary")
    # rows that repeat a doc_id: one of their edges
    return materialize(edges.groupBy("source", "no", "back").agg(F.min("prints").alias("prints")))


def grown_runs(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, grow_words: int = GROW_WORDS) -> DataFrame:
    """(doc_id, runs): for each document with repeated runs their first and last unit, words, and the words next to their
    first occurrence on either side, as hashes."""
    runs = repeated_runs(docs, unit, min(SEED_WORDS, least_words))
    edges = _edges(docs, runs, unit, grow_words)
    side = lambda back, place, name: edges.where(F.col("back") == back).select("source", F.col("no").alias(place), F.col("prints").alias(name))
    both = runs.join(side(True, "before", "left"), ["source", "before"], "left").join(side(False, "after", "right"), ["source", "after"], "left")
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "words", "left", "right"))).alias("runs"))


def _common(words: list[bytes], prints: bytes | None) -> int:
    """How many words in front are those of `prints`."""
    n = 0
    while prints and n < len(words) and prints[8 * n : 8 * n + 8] == words[n]:
        n += 1
    return n


def spans_of(text: str, runs: list, unit: str, least_words: int, grow_words: int) -> tuple[list[tuple[int, int]], int]:
    """(start, finish) in code points of the runs that have `least_words` words when they have grown, word by word, into the units
    next to them as far as these agree with those next to their first occurrence; and how many units those runs have."""
    ends = [0, *cuts(text, unit)]
    spans, units = [], 0
    for r in runs:
        if r["last"] + 1 >= len(ends):
            continue
        start, finish, words = ends[r["first"]], ends[r["last"] + 1], r["words"]
        if r["first"] and r["left"]:
            before = text[ends[r["first"] - 1] : start]
            n = _common(word_prints(before, True, grow_words), r["left"])
            words, start = words + n, start - (len(before) - [m.start() for m in _WORD.finditer(before)][-n] if n else 0)
        if r["last"] + 2 < len(ends) and r["right"]:
            after = text[finish : ends[r["last"] + 2]]
            n = _common(word_prints(after, False, grow_words), r["right"])
            words, finish = words + n, finish + ([m.end() for m in _WORD.finditer(after)][n - 1] if n else 0)
        if words >= least_words:
            units += r["last"] + 1 - r["first"]
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(finish, spans[-1][1]))
            else:
                spans.append((start, finish))
    return spans, units


def dedup_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, removed_col: str = "removed", count_col: str = "removed_units", grow_words: int = GROW_WORDS) -> DataFrame:
    """Remove from the texts every repeated passage; add its spans, in the original text's code points, and the number of units.

    The unit hashed is the line, which ends at a line break or at a sentence's end, or the paragraph between empty lines.
    Normalised units are grouped by digest over all documents; the earliest occurrence (doc_id, then position) stays. Successive
    repeated units form a run. A run of SEED_WORDS words or more grows word by word into the units beside it, as far as their
    words are those beside the first occurrence of its longest unit, by `grow_words` words a side at most; so a passage's first and
    last sentence go too, wherever it was pasted. Runs of `least_words` words or more go (1: every repeated unit).
    A unit or word goes with the blanks behind it, and what is kept is joined as it stands. Documents with a null text or id pass
    unchanged; rows that repeat a doc_id lose what was found under it and fits their text, but never each other's units.
    Extra columns pass through, those named like the new ones are replaced.
    """
    docs = docs.drop(removed_col, count_col)
    name, new = fresh(docs, "runs"), fresh(docs, "new")
    found = grown_runs(docs, unit, least_words, grow_words).withColumnRenamed("runs", name)
    empty = F.array().cast(found.schema[name].dataType)

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, runs, strict=True):
            text = text.as_py()
            spans, units = spans_of(text, own.as_py(), unit, least_words, grow_words)
            at, kept = 0, []
            for start, finish in spans:
                kept.append(text[at:start])
                at = finish
            out.append({"text": "".join(kept) + text[at:], "spans": [{"start": a, "finish": b} for a, b in spans], "units": units})
        span = pa.struct([("start", pa.int64()), ("finish", pa.int64())])
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(span)), ("units", pa.int64())]))

    cut = F.arrow_udf(cut, f"text string, spans {_SPANS}, units bigint")
    hit = F.col(name).isNotNull() & F.col("text").isNotNull()
    both = docs.join(found, "doc_id", "left")
    done = both.withColumn(new, cut(F.when(hit, F.col("text")).otherwise(F.lit("")), F.when(hit, F.col(name)).otherwise(empty)))
    return done.select(
        *[F.when(hit, F.col(f"{new}.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.col(f"{new}.spans"), F.array().cast(_SPANS)).alias(removed_col), F.coalesce(F.col(f"{new}.units"), F.lit(0).cast("long")).alias(count_col),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_removed units, n_removed_chars, removed (start:finish, comma-joined) and kept_sha256 of every document."""
    rows = docs.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    return dedup_units(rows).select(
        "doc_id", "n_chars", F.col("removed_units").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["finish"] - s["start"]).alias("n_removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["finish"].cast("string"))), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
