"""Text normalisation as Column functions; only texts that aren't plain, or in normal form, go to Python, in Arrow batches."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decomposition leaves alone, with their plain spellings.
SPELLINGS = {"đ": "d", "ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "þ": "th", "ð": "d", "ı": "i"}


#: Rows whose values are Python's at once. An Arrow batch may hold 64 MB, and texts of other than Latin characters take two or four bytes a character.
ROWS = 64


def row_by_row(fn: Callable, kind: str, of: pa.DataType, nulls: bool = False) -> Callable[[Column], Column]:
    """A column function of a Python function of one value; nulls stay null and aren't handed over unless `nulls`. Batches stay Arrow's, ROWS
    values at a time are Python's."""

    def piece(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None and not nulls else fn(v) for v in x.to_pylist()], of)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            if x.null_count == len(x) and not (nulls and len(x)):
                yield pa.nulls(len(x), of)
            else:
                yield pa.concat_arrays([piece(x[k : k + ROWS]) for k in range(0, len(x), ROWS)])

    return F.arrow_udf(run, kind)


@functools.cache
def suspects(form: str) -> str:
    """A regular expression class of the characters that may keep a text from being in a normal form: those that the form changes, those that
    combine, and those that may close up with a character before them. A text without them is in that form as it stands."""
    points = range(0x80, sys.maxunicode + 1)
    parts = (unicodedata.decomposition(chr(c)) for c in points)
    # the seconds of canonical pairs
    seconds = {int(x.split()[1], 16) for x in parts if x and x[0] != "<" and len(x.split()) == 2}
    vowels, finals = set(range(0x1161, 0x1176)), set(range(0x11A8, 0x11C3))  # jamo close up by rule
    odd = [c for c in points if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize(form, chr(c)) != chr(c) or form == "NFC" and (c in seconds or c in vowels or c in finals))]
    runs: list[list[int]] = []
    for c in odd:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _normal(x: Column | str, form: str) -> Column:
    """A normal form; only texts that may not be in it leave the JVM. Null stays null."""
    c = F.col(x) if isinstance(x, str) else x
    # characters of no concern go first, as the class is slow on long texts
    rest = F.regexp_replace(c, {"NFC": r"[\x00-\x{2FF}]+", "NFD": r"[\x00-\x7F]+"}[form], "")
    odd = rest.rlike(suspects(form))

    put = row_by_row(lambda s: unicodedata.normalize(form, s), "string", pa.string())
    return F.when(odd, put(F.when(odd, c))).otherwise(c)


def nfc(x: Column | str) -> Column:
    """Unicode normal form C; null stays null."""
    return _normal(x, "NFC")


def nfd(x: Column | str) -> Column:
    """Unicode normal form D; null stays null."""
    return _normal(x, "NFD")


def bare(x: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(nfd(F.lower(x)), r"\p{Mn}", "")


def spelled(char: str) -> str:
    """A plain spelling of a letter or digit of any script that names its letters by their sounds, from its Unicode name; else nothing.

    Alphabets are spelled by how a letter's name begins, or ends where it begins with e (el is l); syllables by their whole name. Chinese characters
    have no sounds in their names.
    """
    if char in SPELLINGS:
        return SPELLINGS[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    name = unicodedata.name(char, "")
    jamo = re.match(r"HANGUL (CHOSEONG|JUNGSEONG|JONGSEONG) (.*)", name)
    if jamo:
        sound = jamo[2].split("-")[0].lower()
        if jamo[1] == "JUNGSEONG":
            return sound
        # the one letter that is silent in front and nasal at the end
        return {"CHOSEONG": "", "JONGSEONG": "ng"}[jamo[1]] if sound == "ieung" else re.sub("[aeiouy].*", "", sound.removeprefix("ssang"))
    kind = re.match(r"(.*?) (SMALL LETTER|CAPITAL LETTER|LETTER|SYLLABLE|VOWEL SIGN|CHARACTER) (.*)", name)
    if not kind or unicodedata.category(char)[0] not in "LM":
        return ""
    script, what, sound = kind[1], kind[2], re.sub(r"^(FINAL|SHORT|LONG|SMALL|SHA LAKKHANGYAO) ", "", kind[3]).split(" ")[0].split("-")[0].lower()
    if kind[3].endswith("SIGN") or not sound.isalpha():
        return ""
    if script.split(" ")[0] in ("GREEK", "CYRILLIC", "HEBREW", "ARABIC", "ARMENIAN", "GEORGIAN", "COPTIC", "LATIN") and what != "SYLLABLE":
        if re.fullmatch("e[^aeiou]", sound):
            return sound[1]
        return re.match("y[aeiou]$|[^aeiou]+|[aeiou]", sound)[0]
    return sound


class _Spellings(dict):
    """For `str.translate`: characters are looked up once; ASCII stays, marks that only modify go."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if point < 128 else "" if unicodedata.category(c) == "Mn" and not spelled(c) else spelled(c)
        return self[point]


_SPELLED = _Spellings()


def match_key_a(x: Column) -> Column:
    """Lower case, the letters of all scripts but Chinese characters spelled in plain Latin ones, only a-z and 0-9 kept; null gives the empty string."""
    low = F.lower(x)
    odd = low.rlike(r"[^\x00-\x7F]")

    plain = row_by_row(lambda s: unicodedata.normalize("NFD", s).translate(_SPELLED), "string", pa.string())
    return F.coalesce(F.regexp_replace(F.when(odd, plain(F.when(odd, low))).otherwise(low), "[^a-z0-9]", ""), F.lit(""))


def match_key_b(x: Column) -> Column:
    """Lower case without accents, blanks, underscores and hyphens; other letters such as đ stay. Null is the text None."""
    return F.regexp_replace(bare(F.coalesce(x.cast("string"), F.lit("None"))), r"(?U)[\s\x1c-\x1f_\-]", "")


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


#: Fixed value: the characters that names of files can't have.
NOT_IN_NAMES = r'[\\/:*?"<>|]'


def safe_name(x: Column, chars: int) -> Column:
    """Characters that file names can't have become underscores; at most `chars` characters."""
    return F.left(F.regexp_replace(x, NOT_IN_NAMES, "_"), F.lit(chars))


def base_name(x: Column, hyphens: bool = False) -> Column:
    """A file's name without folder and extension, blanks (and hyphens, if asked) as underscores."""
    stem = F.regexp_replace(F.regexp_replace(x, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.translate(stem, " -" if hyphens else " ", "__" if hyphens else "_")


def known_name(x: Column, names: dict[str, str]) -> Column:
    """The name that `names` gives, else the value itself."""
    if not names:
        return x
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), x)


def segment_name_v1(base: Column, chapter: Column, number: Column, title: Column, chars: int = 50) -> Column:
    return F.format_string("%s_pham_%02d_kinh_%03d_%s.json", base, chapter, number, safe_name(title, chars))


def segment_name_v2(base: Column, chapter: Column, chapter_slug: Column, number: Column, slug: Column, chars: int = 200) -> Column:
    """Base name, then number and slug of chapter and sutra as far as they are there."""
    no_blank = lambda s: F.when(s != "", s)
    parts = F.concat_ws(
        "_", base,
        F.when(chapter > 0, F.concat_ws("_", F.format_string("pham_%02d", chapter), no_blank(chapter_slug))),
        F.when(number > 0, F.concat_ws("_", F.format_string("kinh_%03d", number), no_blank(slug))),
    )
    return F.concat(safe_name(F.translate(F.replace(parts, F.lit("__"), F.lit("_")), " ", "_"), chars), F.lit(".json"))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")
