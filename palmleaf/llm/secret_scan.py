"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models compared by likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base kinds and the least length of what counts of a match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the Markov models.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Strings of at least this many of those characters are scored.
CANDIDATE_LEAST = 20
#: Mean log-likelihood ratio (nats a transition) from which a candidate is a secret.
RATIO_LEAST = 0.45
#: Bounds of the training sample: about this many documents' words, and as many random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 250, 2000

#: The same for candidates of letters only, among which odd words and names are common.
LETTERS_RATIO_LEAST = 0.9
#: Random strings have at least so many different characters; repeats of a few are not keys.
DISTINCT_LEAST = 8
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_BLOCK, _CHUNK = 64, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it stands there, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """The running `join` (sum, greatest, least) of an array of ints without nulls.

    An aggregate that gathers an array copies it at each step; here blocks are joined first, then their results in the same
    way, and each entry is joined with those before it in its block and the blocks before that.
    """
    fold = lambda part, start: F.aggregate(part, start, lambda acc, x: F.coalesce(join(acc, x), x))
    none = F.lit(None).cast("int")

    def whole(v: Column) -> Column:
        return F.transform(v, lambda x, i: fold(F.slice(v, 1, i + 1), none))

    def blocked(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int"))
        done = running(F.transform(blocks, lambda j: F.coalesce(fold(F.slice(v, j * _BLOCK + 1, _BLOCK), none), F.lit(0))), join, levels - 1)
        return _let(done, lambda d: F.transform(v, lambda x, i: fold(F.slice(v, i - i % _BLOCK + 1, i % _BLOCK + 1), F.get(d, F.floor(i / _BLOCK).cast("int") - 1))))

    return _let(values, lambda v: F.when(F.size(v) <= _BLOCK, whole(v)).otherwise(blocked(v)) if levels else whole(v))


def _found(text: Column, pattern: str, kind: int, least: int, group: int, likely: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern's leftmost matches that don't overlap, as far as `group` has `least` characters and the match is `ok`.

    The pieces between the matches and the matches themselves alternate, so their running lengths are the offsets.
    Texts that the (weaker, cheaper) pattern `likely` doesn't find are not looked at again.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    fine = F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("n"), ((F.length(p) >= least) & (ok(w) if ok else F.lit(True))).alias("ok")))
    rows = F.zip_with(F.split(text, pattern, -1), fine, lambda gap, m: F.struct((F.length(gap) + m["n"]).alias("step"), m["n"].alias("n"), m["ok"].alias("ok")))

    def spans(r: Column) -> Column:
        ends = running(F.transform(r, lambda x: x["step"]), lambda x, y: x + y)
        return F.transform(
            F.filter(F.zip_with(r, ends, lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["ok"].alias("ok"))), lambda x: x["ok"]),
            lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")),
        )

    # the piece after the last match has no match beside it
    some = F.filter(rows, lambda r: r["n"].isNotNull())
    return F.when(text.rlike(likely), _let(some, spans)).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the fixed patterns by start, then kind; code points, end exclusive. Null text is empty."""
    text = F.coalesce(text, F.lit(""))
    # a run of one character class is matched whole, so the least length can stand in the pattern
    access = _found(text, r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), 1, ACCESS_LEAST, 0, "AKIA[A-Z0-9]{12}")
    hexes = _found(text, r"(?<![0-9a-f])[0-9a-f]{%d,}+" % HEX_LEAST, 2, HEX_LEAST, 0, "(?<![0-9a-f])[0-9a-f]{32}")
    return F.array_sort(F.concat(_found(text, ASSIGN, 0, ASSIGN_LEAST, 2, ASSIGN), access, hexes))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """Training strings (s, random): generated random ones, and the words, joined words and numbers of about SAMPLE_DOCS documents."""
    spark = docs.sparkSession
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    key = F.base64(F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)))
    plain = F.regexp_replace(key, "=", "")
    rand = spark.range(SAMPLE_RANDOM).select(
        F.explode(F.array(plain, F.translate(plain, "+/", "-_"), F.regexp_replace(plain, "[+/]", ""), F.upper(F.regexp_replace(plain, "[+/]", "")))).alias("s")
    )
    lot = F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1 << 30)) / (1 << 30)
    words = docs.where(lot < share).select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pairs = words.select(
        F.explode(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")
    ).where("p.a is not null and p.b is not null")
    a, b = F.lower("p.a"), F.lower("p.b")
    joined = pairs.select(
        F.explode(F.array(F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.upper(F.concat(a, F.lit("_"), b)), F.concat(a, F.lit("-"), b), F.concat(F.lit("/"), a, F.lit("/"), b))).alias("s")
    )
    number = F.concat((F.col("id") * 1_000_003).cast("string"), F.crc32(F.col("id").cast("string").cast("binary")).cast("string"))
    # common names of a program, a path or a host stand among the ordinary strings in any corpus
    fixed = spark.range(200).select(F.explode(F.array(*[F.lit(x) for x in ("http", "https/www", "index", "version", "config", "example", "user_name", "README")])).alias("s"))
    ordinary = joined.union(spark.range(SAMPLE_RANDOM).select(number.alias("s"))).union(fixed)
    return rand.withColumn("random", F.lit(True)).union(ordinary.withColumn("random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of every pair of successive characters of ALPHABET.

    First-order models with add-one smoothing from `samples` (s, random); only the counts of pairs of characters, which
    the alphabet bounds, come to the driver. Rows with nulls and characters outside the alphabet don't count.
    """
    at = F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1)))
    pairs = samples.where("s is not null and random is not null and length(s) > 1").select(
        "random", F.explode(F.transform(at, lambda i: F.substring("s", i, F.lit(2)))).alias("two")
    )
    index = {c: k for k, c in enumerate(ALPHABET)}
    n = len(ALPHABET)
    counts = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    valid = pairs.where(F.col("two").rlike("^[A-Za-z0-9+/_-]{2}$")).groupBy("random", "two").count()
    for r in valid.collect():
        counts[r["random"]][index[r["two"][0]] * n + index[r["two"][1]]] += r["count"]
    rows = {k: [sum(v[i * n : (i + 1) * n]) for i in range(n)] for k, v in counts.items()}
    return [math.log(counts[True][k] / rows[True][k // n]) - math.log(counts[False][k] / rows[False][k // n]) for k in range(n * n)]


def ratio(string: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's transitions, random against ordinary; its characters must be of ALPHABET."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    chars = F.filter(F.split(string, "", -1), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = _let(codes, lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.get(table, a * n + b)))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (F.length(string) - 1)


def random_like(string: Column, ratios: list[float], least: float = RATIO_LEAST, letters_least: float = LETTERS_RATIO_LEAST) -> Column:
    """Whether the model of random strings explains a candidate better, by `least` nats a transition or more (`letters_least`
    where it has no digit). Numbers and repeats of a few characters aren't keys, whatever their ratio."""
    varied = F.size(F.array_distinct(F.split(string, "", -1))) >= DISTINCT_LEAST
    bound = F.when(string.rlike("[0-9]"), F.lit(least)).otherwise(F.lit(letters_least))
    return string.rlike("[A-Za-z]") & varied & (ratio(string, ratios) >= bound)


def markov_spans(text: Column, ratios: list[float], least: float = RATIO_LEAST) -> Column:
    """Spans of the runs of CANDIDATE_LEAST or more characters of ALPHABET that are `random_like`."""
    text = F.coalesce(text, F.lit(""))
    char = r"[A-Za-z0-9+/_-]"
    pattern = r"(?<!%s)%s{%d,}+" % (char, char, CANDIDATE_LEAST)
    return _found(text, pattern, 3, CANDIDATE_LEAST, 0, pattern, lambda w: random_like(w, ratios, least))


def _free(fixed: Column, more: Column) -> Column:
    """All of `fixed` and those of `more` that meet none of them, by start, then kind."""

    def kept(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(-1)), F.greatest)
        after = F.reverse(running(F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(2**31 - 1)), F.least))
        return _let(
            F.struct(before.alias("b"), after.alias("a")),
            lambda x: F.filter(spans, lambda s, i: (s["kind"] < 3) | ((F.get(x["b"], i) <= s["start"]) & (F.get(x["a"], i) >= s["end"]))),
        )

    return F.when(F.size(more) == 0, fixed).otherwise(_let(F.array_sort(F.concat(fixed, more)), kept))


def scan(docs: DataFrame, ratios: list[float], spans_col: str = "spans") -> DataFrame:
    """Add `spans_col`: all spans by start, then kind. Base spans stay; spans of the models are added where they meet none.

    A null text has no spans, nor has an empty one. Row by row, without a shuffle, so rows that repeat a doc_id are rows of
    their own; the work follows a text's length. Extra columns pass through, one named
    `spans_col` is replaced.
    """
    docs = docs.drop(spans_col)
    text = F.col("text")
    found = _let(F.struct(base_spans(text).alias("fixed"), markov_spans(text, ratios).alias("more")), lambda x: _free(x["fixed"], x["more"]))
    return docs.withColumn(spans_col, found)


def redact(docs: DataFrame, spans_col: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span in the text by `mask`; spans that overlap become one. Null texts stay null.

    What is between the spans is taken from chunks of the text, so that no piece is looked for from the start.
    """
    text = F.col("text")

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _CHUNK).cast("int")
        some = F.array_join(F.slice(chunks, first + 1, F.floor(b / _CHUNK).cast("int") - first + 1), "")
        return F.substring(some, a % _CHUNK + 1, b - a)

    def masked(x: Column) -> Column:
        heads = F.filter(F.transform(x["s"], lambda s, i: F.struct(F.coalesce(F.get(x["m"], i - 1), F.lit(0)).alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        last = F.array(F.struct(F.get(x["m"], F.size(x["m"]) - 1).alias("a"), F.length(text).alias("b")))
        return F.array_join(F.transform(F.concat(heads, last), lambda g: piece(x["c"], g["a"], g["b"])), mask)

    parts = F.struct(
        F.col(spans_col).alias("s"), running(F.transform(spans_col, lambda s: s["end"]), F.greatest).alias("m"),
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), F.lit(0)).alias("c"),
    )
    return docs.withColumn("text", F.when(F.size(spans_col) > 0, _let(parts, masked)).otherwise(text))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def model(spark: SparkSession, docs: DataFrame) -> list[float]:
    """The ratios that the registered query and the pipeline use."""
    return train(labelled_samples(docs.select("doc_id", "text")))


def summary(found: DataFrame) -> DataFrame:
    """Of (doc_id, spans): counts by base kind, the digest of the base spans, all spans as text, and the count of the models'."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count(3).alias("n_markov"),
    )


def report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """The summary of every document's spans, of base kinds and of the models."""
    return summary(scan(docs.select("doc_id", "text"), ratios))
