"""Heading, delimiter, sentence and answer patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palmleaf.functions.text import is_blank, strip

# The patterns of the document format (Java dialect; case and classes by Unicode, lines end at line feeds only).
CHAPTER_V1 = r"(?iuUd)^(?:\d{1,2}\.\s*)?PHẨM\s+(.+)$"
PART_V1 = r"(?iuUd)^PHẦN\s+(\d+)$"
SUTRA_V1 = r"(?iuUd)^(\d{1,3})\.\s*KINH\s+(.+)$"
CHAPTER_V2 = r"(?iuUd)^(PHẨM|PHẦN|CHƯƠNG)\s+(THỨ\s+)?([IVXLCDM\d]+|[A-ZĐ][a-zđÀ-Ỹ]+)\s*[:\.]?\s*(.*)"
SUTRA_V2 = r"(?iuUd)^((\d+(\.|\s+)?)|(KINH\s+))\s*(.+)"
DELIMITER_V2 = r"(?iu)---o0o---"
DELIMITER_LINE = r"^(-+o0o-+|-+O0O-+)$"
DELIMITERS_V1 = ["---o0o---", "o0o"]
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-ZĐ])"

# Answers of the service.
NO_INFO = "Xin lỗi, tôi không tìm thấy thông tin đủ chi tiết trong các Kinh đã được cung cấp để trả lời câu hỏi này."
NO_INFO_PHRASES = [NO_INFO, "tôi không tìm thấy thông tin", "không có thông tin này"]
ERROR_PREFIX = "Xin lỗi, có lỗi xảy ra khi xử lý yêu cầu của bạn:"
ASK_AGAIN = "Vui lòng nhập câu hỏi."


def is_chapter_v1(x: Column) -> Column:
    return x.rlike(CHAPTER_V1) | x.rlike(PART_V1)


def is_sutra_v1(x: Column) -> Column:
    return ~is_chapter_v1(x) & x.rlike(SUTRA_V1)


def is_delimiter_v1(x: Column) -> Column:
    return F.translate(strip(x), " \t", "").isin(DELIMITERS_V1)


def is_delimiter_v2(x: Column) -> Column:
    return x.rlike(DELIMITER_V2)


def is_chapter_v2(x: Column) -> Column:
    return ~is_delimiter_v2(x) & x.rlike(CHAPTER_V2)


def is_sutra_v2(x: Column) -> Column:
    return ~is_delimiter_v2(x) & ~x.rlike(CHAPTER_V2) & x.rlike(SUTRA_V2)


def roman_value(x: Column) -> Column:
    """The value of a roman numeral in either case; null for anything else."""
    value = F.create_map(*[F.lit(v) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for v in kv])
    digits = F.transform(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), lambda c: F.try_element_at(value, c))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    # from the right, a digit below the one after it counts negative
    step = lambda a, d: F.struct((a["total"] + F.when(d < a["last"], -d).otherwise(d)).alias("total"), d.alias("last"))
    return F.when(x.rlike("(?i)^[IVXLCDM]+$"), F.aggregate(F.reverse(digits), start, step, lambda a: a["total"]))


def chapter_number(x: Column) -> Column:
    """A roman numeral's or an integer's value; null for words, which count on from the chapter before."""
    return F.coalesce(roman_value(x), x.try_cast("int"))


def chapter_title_v2(x: Column) -> Column:
    """TYPE NUMBER: name, or TYPE NUMBER without a name."""
    part = lambda k: F.regexp_extract(x, CHAPTER_V2, k)
    head = F.concat_ws(" ", F.upper(part(1)), F.upper(part(3)))
    return F.when(part(4) != "", F.concat(head, F.lit(": "), strip(part(4)))).otherwise(head)


def sentences(x: Column) -> Column:
    return F.split(x, SENTENCE_BREAK)


def is_no_info(answer: Column) -> Column:
    """Whether an answer is missing, blank or says anywhere that nothing was found."""
    low = F.lower(answer)
    said = F.lit(False)
    for phrase in NO_INFO_PHRASES:
        said = said | low.contains(phrase.lower())
    return is_blank(answer) | F.coalesce(said, F.lit(False))


def is_error(answer: Column) -> Column:
    return answer.startswith(ERROR_PREFIX)
