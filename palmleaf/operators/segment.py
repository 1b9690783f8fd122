"""Segmentation of paragraph streams by running state; two strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.config import BY_CHAPTER, BY_CHAPTER_AND_SUTRA, BY_SUTRA, UNKNOWN
from palmleaf.functions import patterns as P
from palmleaf.functions.text import strip
from palmleaf.operators.scan import scan


def _facts(rows: DataFrame, **facts: Column) -> DataFrame:
    """`rows` with facts of their whole document, which are aggregated before anything is shuffled."""
    own = F.struct("doc_id")
    found = rows.groupBy(own.alias("__doc")).agg(*[c.alias(k) for k, c in facts.items()])
    return rows.join(found, own == F.col("__doc")).drop("__doc")


def structure_label(chapters: Column, sutras: Column) -> Column:
    """The document-wide label from whether it has chapters and sutras."""
    return (
        F.when(chapters & sutras, BY_CHAPTER_AND_SUTRA).when(chapters, BY_CHAPTER).when(sutras, BY_SUTRA).otherwise(UNKNOWN)
    )


def clean_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Stripped paragraphs; blank and null ones go."""
    return paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")


def running_v1(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their state under strategy 1: headings cut segments and aren't content.

    Adds is_chapter, is_sutra, is_delimiter, segment, chapter_no, chapter_title, title, number. The sutra title is unknown after a
    chapter heading; two or more paragraphs before the first heading count as a sutra `<doc>_full`, numbered 1, whose number
    the next sutra continues unless a chapter comes between.
    """
    x, chapter, sutra = F.col("text"), F.col("is_chapter"), F.col("is_sutra")
    flags = clean_paragraphs(paragraphs).withColumns({"is_chapter": P.is_chapter_v1(x), "is_sutra": P.is_sutra_v1(x), "is_delimiter": P.is_delimiter_v1(x)})
    head = chapter | sutra
    steps = scan(
        flags, "doc_id", "para_no", {"segment": head.cast("int"), "chapter_no": chapter.cast("int"), "sutras": sutra.cast("int")},
        # a segment's title is that of the heading it begins with
        {"chapter_title": F.when(chapter, x), "head": F.when(head, F.struct(F.when(sutra, x).alias("title")))},
    )
    steps = scan(steps, "doc_id", "para_no", carries={"earlier": F.when(chapter, F.col("sutras") - sutra.cast("int"))})
    content = ~head & ~F.col("is_delimiter")
    steps = _facts(steps, front=F.count_if(content & (F.col("segment") == 0)), heads=F.max("segment"))
    full = (F.col("front") >= 2) | ((F.col("heads") == 0) & (F.col("front") > 0))
    return steps.withColumns(
        {
            "full": full, "chapter_title": F.coalesce("chapter_title", F.lit(UNKNOWN)),
            "title": F.when((F.col("segment") == 0) & full, F.concat(F.col("doc_id").cast("string"), F.lit("_full"))).otherwise(F.coalesce("head.title", F.lit(UNKNOWN))),
            "number": (F.col("sutras") - F.coalesce("earlier", F.lit(0)) + F.when(full & (F.col("chapter_no") == 0), 1).otherwise(0)).cast("int"),
            "content": content,
        }
    ).drop("sutras", "head", "earlier", "front", "heads")


def segments_v1(paragraphs: DataFrame, literal_labels: bool = False) -> DataFrame:
    """(doc_id, segment, chapter_no, chapter_title, number, title, label, lines) under strategy 1.

    Text under no known sutra title is dropped. The label is the document's; with `literal_labels` only the last segment
    has it and earlier ones are unknown, as in a single pass that labels at its end.
    """
    state = running_v1(paragraphs)
    state = _facts(state, label=structure_label(F.bool_or("is_chapter"), F.bool_or("is_sutra")), last_segment=F.max("segment"))
    rows = state.where(F.col("content") & (F.col("title") != UNKNOWN))
    keys = ["doc_id", "segment", "chapter_no", "chapter_title", "number", "title", "label", "last_segment"]
    out = rows.groupBy(*keys).agg(ordered_lines().alias("lines"))
    if literal_labels:
        out = out.withColumn("label", F.when(F.col("segment") == F.col("last_segment"), F.col("label")).otherwise(UNKNOWN))
    return out.drop("last_segment")


def ordered_lines() -> Column:
    """A group's texts in paragraph order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda p: p["text"])


def running_v2(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs from the first delimiter on, with their state under strategy 2: only delimiters cut, headings are content.

    Adds is_delimiter, is_chapter, is_sutra, segment, chapter_no, chapter_title, title, number. A chapter's number is parsed, or one more
    than the chapter before where it is a word. Titles carry on across delimiters; a chapter resets the sutra's.
    """
    x, chapter, sutra = F.col("text"), F.col("is_chapter"), F.col("is_sutra")
    flags = clean_paragraphs(paragraphs).withColumns({"is_delimiter": P.is_delimiter_v2(x), "is_chapter": P.is_chapter_v2(x), "is_sutra": P.is_sutra_v2(x)})
    flags = scan(flags, "doc_id", "para_no", {"segment": F.col("is_delimiter").cast("int")}).where("segment > 0")
    steps = flags.withColumn("parsed", F.when(chapter, P.chapter_number(F.regexp_extract(x, P.CHAPTER_V2, 3))))
    steps = scan(
        steps, "doc_id", "para_no", {"epoch": chapter.cast("int"), "words": (chapter & F.col("parsed").isNull()).cast("int"), "sutras": sutra.cast("int")},
        {"base": F.col("parsed"), "chapter_title": F.when(chapter, P.chapter_title_v2(x))},
    )
    # what had been counted where the last numbered chapter, and the last chapter, began; and the last sutra with the chapter it is in
    steps = scan(
        steps, "doc_id", "para_no",
        carries={
            "counted": F.when(F.col("parsed").isNotNull(), F.col("words")), "earlier": F.when(chapter, F.col("sutras") - sutra.cast("int")),
            "under": F.when(sutra, F.struct("epoch", F.col("text").alias("title"))),
        },
    )
    since = lambda c, before: F.col(c) - F.coalesce(before, F.lit(0))
    return steps.withColumns(
        {
            "chapter_no": (F.coalesce("base", F.lit(0)) + since("words", "counted")).cast("int"), "chapter_title": F.coalesce("chapter_title", F.lit(UNKNOWN)),
            "title": F.when(F.col("under.epoch") == F.col("epoch"), F.col("under.title")).otherwise(UNKNOWN), "number": since("sutras", "earlier").cast("int"),
        }
    ).drop("parsed", "epoch", "words", "sutras", "base", "counted", "earlier", "under")


def segments_v2(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, segment, chapter_no, chapter_title, number, title, label, lines) under strategy 2; a segment bears the state at its end."""
    state = running_v2(paragraphs)
    state = _facts(state, label=structure_label(F.bool_or("is_chapter"), F.bool_or("is_sutra"))).where("not is_delimiter")
    last = lambda c: F.max_by(c, "para_no").alias(c)
    return state.groupBy("doc_id", "segment", "label").agg(
        last("chapter_no"), last("chapter_title"), last("number"), last("title"), ordered_lines().alias("lines")
    )


def whole_documents(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, body): all paragraphs, stripped, blank ones too, joined by line feeds."""
    rows = paragraphs.select("doc_id", "para_no", strip(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(ordered_lines(), "\n").alias("body"))


def without_delimiter_lines(lines: Column, trailing_only: bool = False) -> Column:
    """Lines as they are saved: strategy 2 drops blank and delimiter lines anywhere, strategy 1 delimiters at the end."""
    if not trailing_only:
        return F.filter(lines, lambda s: (strip(s) != "") & ~strip(s).rlike(P.DELIMITER_LINE))
    kept = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("i"), P.is_delimiter_v1(s).alias("cut"))), lambda x: ~x["cut"])
    return F.slice(lines, 1, F.coalesce(F.array_max(F.transform(kept, lambda x: x["i"])) + 1, F.lit(0)))
