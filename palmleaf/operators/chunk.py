"""Sentence splitting and greedy packing of sentences into chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.patterns import sentences
from palmleaf.functions.text import row_by_row, strip
from palmleaf.shared import fresh


def pack(parts: list[str], most: int) -> list[str]:
    """Sentences packed greedily, each with a blank after it, into stripped chunks of at most `most` characters; a longer sentence stands alone."""
    out, cur, size = [], [], 0
    for s in parts:
        if cur and size + len(s) + 1 > most:
            out.append(" ".join(cur).strip())
            cur, size = [], 0
        cur.append(s)
        size += len(s) + 1
    return [*out, " ".join(cur).strip()]


def chunks(text: Column, most: int = 512) -> Column:
    """The chunks of a text; null stays null.

    Sentences are split in the JVM. They are packed in Arrow batches, in linear time: `aggregate` copies what it has gathered
    at every step, which a text of some megabytes doesn't survive.
    """
    return row_by_row(lambda parts: pack(parts, most), "array<string>", pa.list_(pa.string()))(sentences(text))


def chunk_rows(rows: DataFrame, text_col: str = "text", most: int = 512, chunk_col: str = "content") -> DataFrame:
    """One row per chunk: the input's columns without the text, `chunk_no` (from 0) and the chunk. Null and blank texts give
    none. Columns named like the new ones are replaced."""
    full = rows.where(strip(F.col(text_col)) != "")
    rest = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in (text_col.lower(), chunk_col.lower(), "chunk_no")]
    return full.select(*rest, F.posexplode(chunks(F.col(text_col), most)).alias("chunk_no", chunk_col))


#: Values of the first order column whose rows are numbered in one task.
STRETCH = 1024


def number_chunks(rows: DataFrame, file_col: str = "source_file", order: tuple[str, ...] = ("pos", "chunk_no"), out: str = "doan_so") -> DataFrame:
    """Ordinals from 1 for each file, in order of node and chunk; the first order column is a number.

    A file may hold most of the rows, so it is numbered in stretches of STRETCH nodes, each from the count of the stretches
    before it. Only those counts meet in a file's window. The rows are worked out twice, once for the counts.
    """
    at, place, begin = (fresh(rows, x) for x in ("at", "place", "begin"))
    stretch = F.floor(F.col(order[0]) / STRETCH)
    counts = rows.groupBy(F.col(file_col).alias("file"), stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.struct(F.col("file").alias("v")).alias(f"{at}f"), F.struct(F.col("stretch").alias("v")).alias(f"{at}s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(begin))
    number = F.row_number().over(Window.partitionBy(file_col, at).orderBy(*order))
    numbered = rows.withColumn(at, stretch).withColumn(place, number)
    # a struct of a null equals another one
    both = numbered.join(offsets, (F.struct(F.col(file_col).alias("v")) == F.col(f"{at}f")) & (F.struct(F.col(at).alias("v")) == F.col(f"{at}s")))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], (F.col(begin) + F.col(place)).alias(out))
