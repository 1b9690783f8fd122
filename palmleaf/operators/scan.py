"""Running sums and carried values along long sequences, in stretches, so that no sequence is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a stretch; stretches of a group of stretches.
STRETCH, FANOUT = 4096, 4096


def _before(rows: DataFrame, sums: list[str], carries: list[str]) -> DataFrame:
    """What precedes each row within its group (key, up): sums of the rows ahead, and their last values that aren't null."""
    ahead = Window.partitionBy("key", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "key", "at", "up", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in sums], *[F.last(c, ignorenulls=True).over(ahead).alias(c) for c in carries]
    )


def _folded(rows: DataFrame, keys: list[str], sums: list[str], carries: list[str], at: str) -> DataFrame:
    """One summary for each of `keys`: sums, and the values last in the order of `at` that aren't null. It combines before the shuffle."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[last(c) for c in carries])


def scan(rows: DataFrame, key: str, order: str, sums: dict[str, Column] | None = None, carries: dict[str, Column] | None = None) -> DataFrame:
    """Add to every row running sums and carried values over the rows of its `key` up to itself, in the order of the integer `order`.

    A sum counts nulls as 0; a carry is the last value that isn't null, or null. Rows are worked on in stretches of STRETCH places
    of `order`; a stretch sums up to one row, FANOUT of these to one row again, and what precedes a stretch is put together from
    these summaries, which are associative. So windows are over a stretch or over FANOUT summaries, and only what is left, a
    row for STRETCH * FANOUT places, is put in order for a key at once. Rows of equal `order` follow each other in any order; rows
    with a null key or order are kept, a null order comes first. Columns named like the new ones are replaced.
    """
    sums, carries = sums or {}, carries or {}
    names, taken = [*sums, *carries], {c.lower() for c in rows.columns}
    tag = "s_"
    while any(c.startswith(tag) for c in taken):
        tag = f"_{tag}"
    inner = {c: f"{tag}{k}" for k, c in enumerate(names)}
    part, plus, kept = [inner[c] for c in sums], [inner[c] for c in carries], [c for c in rows.columns if c not in names]
    stretch = f"{tag}stretch"
    # a struct is never null and equal where its field is null in both, so a null key is a key like others
    group = f"{tag}key"
    cut = rows.withColumns({group: F.struct(F.col(key)), stretch: F.coalesce(F.floor(F.col(order) / STRETCH), F.lit(-1)).cast("long")})
    here = Window.partitionBy(group, stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        *[F.col(f"`{c}`") for c in kept], group, stretch, *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(inner[k]) for k, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(here).alias(inner[k]) for k, c in carries.items()],
    )
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))).alias("at")
    whole = cut.select(F.col(group).alias("key"), stretch, place, *[F.coalesce(c, F.lit(0)).alias(inner[k]) for k, c in sums.items()], *[c.alias(inner[k]) for k, c in carries.items()])
    low = _folded(whole, ["key", stretch], part, plus, "at").withColumnRenamed(stretch, "at").withColumn("up", F.floor(F.col("at") / FANOUT))
    high = _folded(low, ["key", "up"], part, plus, "at").withColumnRenamed("up", "at")
    # a row for each key, with its few groups of stretches in order; each group is paired with the fold of those ahead of it
    listed = high.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", *part, *plus))).alias("groups"))
    empty = F.struct(*[F.lit(0).cast("long").alias(c) for c in part], *[F.lit(None).cast(high.schema[c].dataType).alias(c) for c in plus])
    add = lambda a, g: F.struct(*[(a[c] + g[c]).cast("long").alias(c) for c in part], *[F.coalesce(g[c], a[c]).alias(c) for c in plus])
    ahead = lambda g, i: F.struct(g["at"].alias("up"), F.aggregate(F.slice("groups", 1, i), empty, add).alias("fold"))
    upper = listed.select("key", F.explode(F.transform("groups", ahead)).alias("g")).select("key", F.col("g.up").alias("up"), *[F.col(f"g.fold.{c}").alias(f"{c}u") for c in [*part, *plus]])
    lower = _before(low, part, plus).join(upper, ["key", "up"])
    both = lower.select(
        F.col("key").alias(group), F.col("at").alias(stretch), *[(F.col(c) + F.col(f"{c}u")).alias(f"{c}b") for c in part], *[F.coalesce(c, f"{c}u").alias(f"{c}b") for c in plus]
    )
    return local.join(both, [group, stretch]).select(
        *[F.col(f"`{c}`") for c in kept], *[(F.col(inner[c]) + F.col(f"{inner[c]}b")).alias(c) for c in sums], *[F.coalesce(inner[c], f"{inner[c]}b").alias(c) for c in carries]
    )
