"""The report of flagged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_rows(flags: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Rows with a readable time, newest first (ties by the other columns), times as yyyy-MM-dd HH:mm:ss; without that column, all rows as they are."""
    if time_col not in flags.columns:
        return flags
    at = F.col(time_col).try_cast("timestamp_ntz")
    rest = [c for c in flags.columns if c != time_col]
    return flags.withColumn("__at", at).where("__at is not null").orderBy(F.desc("__at"), *rest).select(
        *[F.date_format("__at", "yyyy-MM-dd HH:mm:ss").alias(c) if c == time_col else F.col(f"`{c}`") for c in flags.columns]
    )


def escaped(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def html_lines(rows: DataFrame, escape: bool = True) -> DataFrame:
    """(line): an HTML table row per input row, in the input's order, nulls as empty cells."""
    cell = lambda c: escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if escape else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return rows.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), cell(c), F.lit("</td>")) for c in rows.columns], F.lit("</tr>")).alias("line"))


def html_table(rows: DataFrame, escape: bool = True, most: int = 20_000) -> str:
    """The whole table as one HTML text, for a page; its rows are ordered on the way here. More than `most` rows are an error:
    write `html_lines` out instead."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are too many for one page")
    head = "".join(f"<th>{c}</th>" for c in rows.columns)
    return "\n".join([f'<table border="1"><thead><tr>{head}</tr></thead><tbody>', *(r["line"] for r in html_lines(rows, escape).collect()), "</tbody></table>"])
