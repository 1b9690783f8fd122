"""Line de-duplication by winnowed fingerprints, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Lines of the shortest repeated run that goes, which is also the number of line hashes in a winnowing window.
LINES = 3
#: A line of more words than this is a passage and goes by itself where it occurred before.
LONG_WORDS = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it stands there, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1; nothing where n is below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def line_table(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, g): for the lines that aren't blank, in order, their digest, position (negative), number from 0 and whether they are long."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    full = F.filter(lines, lambda x: F.trim(x["line"]) != "")
    long = lambda x: (F.length(x) > 2 * long_words) & (F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) > long_words)
    hashed = F.transform(full, lambda x, i: F.struct(F.unhex(F.md5(x["line"])).alias("d"), (-i).alias("back"), x["no"].alias("no"), long(x["line"]).alias("long")))
    return docs.where("doc_id is not null and text is not null").select("doc_id", hashed.alias("g"))


def fingerprints(table: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, print, windows): the winnowed fingerprints, and for each the windows that it stands for.

    A window is `lines` successive lines; its fingerprint is the smallest of their digests, the last of equals. So equal
    windows always have equal fingerprints at equal places. Successive windows share one, which makes them one row here;
    each has its digest, the extension of the fingerprint both ways to `lines` lines, and the numbers of its lines. A long
    line is a fingerprint and a window by itself.
    """
    together = lambda g, i: F.md5(F.concat(*[F.get(g, i + k)["d"] for k in range(lines)]))

    def rows(g: Column) -> Column:
        windows = F.transform(
            _upto(F.size(g) - (lines - 1)),
            lambda i: F.struct(
                F.array_min(F.transform(F.slice(g, i + 1, lines), lambda x: F.struct(x["d"].alias("d"), x["back"].alias("back")))).alias("own"), i.alias("i"),
                F.struct(F.unhex(together(g, i)).alias("digest"), F.transform(F.slice(g, i + 1, lines), lambda x: x["no"]).alias("nos")).alias("w"),
            ),
        )

        def grouped(w: Column) -> Column:
            starts = F.filter(w, lambda x, i: (i == 0) | (x["own"]["back"] != F.get(w, F.greatest(i - 1, F.lit(0)))["own"]["back"]))
            return _let(
                starts,
                lambda s: F.transform(
                    s,
                    lambda x, k: F.struct(
                        x["own"]["d"].alias("print"),
                        F.transform(F.slice(w, x["i"] + 1, F.coalesce(F.get(s, k + 1)["i"], F.size(w)) - x["i"]), lambda y: y["w"]).alias("windows"),
                    ),
                ),
            )

        alone = F.transform(
            F.filter(g, lambda x: x["long"]),
            lambda x: F.struct(x["d"].alias("print"), F.array(F.struct(x["d"].alias("digest"), F.array(x["no"]).alias("nos"))).alias("windows")),
        )
        return F.concat(_let(windows, grouped), alone)

    found = table.select("doc_id", F.explode(_let(F.col("g"), rows)).alias("f"))
    return found.select("doc_id", "f.print", "f.windows")


def repeated_lines(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, gone): the numbers of the lines to delete, for documents that have any.

    Fingerprints that occur once leave first. The others' windows meet by digest: the smallest (doc_id, line) of each is a
    minimum that is aggregated before it is shuffled, and all other members join that one row, in a join that Spark may split.
    So a passage shared by a third of all documents costs one row for each place and no pairs, and a document of equal
    lines costs no more than one of different lines. Every window that occurred before is found, which is every line of
    every run of `lines` lines that occurred before.
    """
    prints = materialize(fingerprints(line_table(docs, long_words), lines))
    # written, so that the join's own shuffle deals it out again and Spark may split a fingerprint that many places share
    repeated = materialize(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"))
    windows = prints.join(repeated, "print").select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.digest", "w.nos")
    windows = materialize(windows)
    place = F.struct("doc_id", F.get("nos", F.lit(0)).alias("no"))
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = windows.join(materialize(first), "digest").where(place > F.col("first"))
    return again.select("doc_id", F.explode("nos").alias("no")).groupBy("doc_id").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, removed_col: str = "removed_lines", lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """Delete later copies of runs of `lines` or more lines, and of single lines of more than `long_words` words; add the deleted
    line numbers as `removed_col`.

    The earliest place (doc_id, then line) stays. Lines are compared byte by byte; blank ones (spaces only) don't count and
    stay. A null text stays null, an empty one empty; rows with a null id pass unchanged. Rows that repeat a doc_id get the
    deletions found under it that fit their lines, but don't delete each other's. Other columns pass through, one named
    `removed_col` is replaced.
    """
    docs = docs.drop(removed_col)
    name, split = fresh(docs, "gone"), fresh(docs, "lines")
    gone = repeated_lines(docs.select("doc_id", "text"), lines, long_words).withColumnRenamed("gone", name)
    # the lines are split before the join, so once, and stand for the text in it
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    both = docs.select(*cols, F.split("text", "\n", -1).alias(split)).join(gone, "doc_id", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(name)), lambda i: F.get(split, i))
    text = F.array_join(F.when(F.col(name).isNull(), F.col(split)).otherwise(kept), "\n")
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(name, F.array().cast("array<int>")).alias(removed_col))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (comma-joined numbers from 0) and kept_sha256 of every document."""
    counted = docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    return dedup_lines(counted).select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
