"""Incremental synchronisation of a target table with its source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OLDEST = "0001-01-01 00:00:00"


def as_time(x: Column) -> Column:
    """A timestamp from a timestamp or ISO text; anything else is the oldest one."""
    return F.coalesce(x.try_cast("timestamp"), F.lit(_OLDEST).cast("timestamp"))


def newest(rows: DataFrame) -> DataFrame:
    """One row an id: the newest, of equally old ones the one with the greatest digest, so that it is the same on every run. Null ids go."""
    rest = [c for c in rows.columns if c != "id"]
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])), 256)
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(as_time(F.col("last_updated")), digest)).alias("r")
    return rows.where("id is not null").groupBy("id").agg(row).select("id", "r.*").select(*[F.col(f"`{c}`") for c in rows.columns])


def diff(source: DataFrame, target: DataFrame, deletes: bool = False) -> DataFrame:
    """(id, action): add, update where the source is strictly newer, unchanged; delete for ids only in the target, if asked.

    One join on id, of ids and times only. A source that repeats an id counts with the newest time; null ids don't count.
    """
    s = source.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.max(as_time(F.col("last_updated"))).alias("s"))
    t = target.select(F.col("id").cast("string").alias("id"), as_time(F.col("last_updated")).alias("t"))
    both = s.join(t, "id", "full" if deletes else "left")
    action = F.when(F.col("t").isNull(), "add").when(F.col("s").isNull(), "delete").when(F.col("s") > F.col("t"), "update").otherwise("unchanged")
    return both.select("id", action.alias("action"))


def apply_changes(source: DataFrame, target: DataFrame, deletes: bool = False) -> DataFrame:
    """The target after the sync: added and updated rows are the source's, others stay; deletes go if asked.

    Rows of source and target share their columns (id, last_updated, ...). Both sides meet once, on id. Of source rows that repeat an
    id the newest counts; rows with a null id are no changes.
    """
    cols = source.columns
    s = newest(source).select(F.col("id").cast("string").alias("id"), F.struct(*cols).alias("s"))
    t = target.select(F.col("id").cast("string").alias("id"), F.struct(*cols).alias("t"))
    both = s.join(t, "id", "full")
    newer = F.col("t").isNull() | (F.col("s").isNotNull() & (as_time(F.col("s.last_updated")) > as_time(F.col("t.last_updated"))))
    if deletes:
        both = both.where("s is not null")
    return both.select(F.when(newer, F.col("s")).otherwise(F.col("t")).alias("row")).select("row.*")


#: Buckets whose counts are summed together before the sums over all of them.
BUCKETS = 4096


def batch_numbers(rows: DataFrame, order: Column, bucket: Column, size: int = 100, out: str = "batch") -> DataFrame:
    """Batches of exactly `size` rows (the last may be short), from 0, in order of (bucket, order).

    A global row number without a global sort: rows are numbered within buckets, and the bucket counts, summed up, give each
    bucket its offset: first within stretches of BUCKETS buckets, then over the stretches, of which some thousand rows times BUCKETS make
    one. `bucket` is an integer, a coarse form of `order` of some thousand rows each.
    """
    dealt = rows.withColumn("__bucket", bucket)
    counts = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("__stretch", F.floor(F.col("__bucket") / BUCKETS))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("__stretch").agg(F.sum("n").alias("m")).select("__stretch", before("m", Window.orderBy("__stretch")).alias("__base"))
    inside = counts.withColumn("__inside", before("n", Window.partitionBy("__stretch").orderBy("__bucket")))
    offsets = inside.join(stretches, "__stretch").select("__bucket", (F.col("__base") + F.col("__inside")).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1
    numbered = dealt.withColumn("__place", place).join(offsets, "__bucket")
    return numbered.withColumn(out, F.expr(f"cast((__offset + __place) div {size} as bigint)")).drop("__bucket", "__place", "__offset")


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], text_col: str = "content", out: str = "embedding", batch: int = 100) -> DataFrame:
    """Vectors from an injected model, `batch` texts a call; null texts are empty ones."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list = []
            for k in range(0, len(texts), batch):
                got += embed_fn([t if isinstance(t, str) else "" for t in texts.iloc[k : k + batch]])
            yield pd.Series(got, dtype=object)

    return rows.withColumn(out, vectors(F.col(text_col)))
