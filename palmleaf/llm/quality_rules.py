"""Quality rules by tokeniser fertility: what public vocabularies make of a text, against bands for its language or script."""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

# What a word is not made of, what counts as a symbol, and the base rules.
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: A band reaches from its quartiles this many times the distance between them, which counts as this much at least (thousandths of a
#: character a token, of the tokens, and of a bit). Its quartiles come from this many documents or more.
REACH, LEAST_SPREAD, LEAST_DOCS = 3.0, {"chars": 100, "bytes": 10, "entropy": 150}, 100
#: Distinct words that a worker remembers before it starts anew, texts and bytes worked on together. They change no result.
CACHE_WORDS, SLICE_TEXTS, SLICE_BYTES = 500_000, 32, 1 << 20
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Vocabulary:
    """A public vocabulary: a sentencepiece model, or, with the pattern that cuts texts, byte-level ranks as tiktoken has them."""

    name: str
    data: bytes
    pattern: str | None = None


class _Encoder:
    """Ids of words, each by itself; and which tokens hold a piece of a character only (fallback to bytes)."""

    def __init__(self, v: Vocabulary):
        if v.pattern is None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=v.data)
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.partial = np.array([model.is_byte(k) for k in range(model.get_piece_size())])
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.data.splitlines())}
            coder = tiktoken.Encoding(v.name, pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [coder.encode_ordinary(f" {w}") for w in words]
            self.partial = np.zeros(max(ranks.values()) + 1, bool)
            for token, k in ranks.items():
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.partial[k] = True


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(x), len(self.data)), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class _Words:
    """Everything that is known of the distinct words met so far."""

    def __init__(self, encoders: list[_Encoder], scripts: dict[str, int], of: dict[str, int]):
        self.encoders, self.scripts, self.of = encoders, scripts, of
        self.number: dict[bytes, int] = {}
        self.chars, self.letters, self.script = _Column(np.int64), _Column(np.int64), _Column(np.int64)
        self.tokens = [(_Column(np.int32), _Column(np.int64), _Column(np.int64), _Column(np.int64)) for _ in encoders]  # ids, start, count, partial ones

    def _letters(self, word: str) -> tuple[int, int]:
        """How many letters, and the script of most of them: the first word of the letters' Unicode names."""
        if word.isascii():
            return sum(map(str.isalpha, word)), self.scripts.setdefault("LATIN", len(self.scripts))
        count: Counter = Counter()
        for c in word:
            if c.isalpha():
                if c not in self.of:
                    self.of[c] = self.scripts.setdefault(unicodedata.name(c, "NONE").split(" ")[0], len(self.scripts))
                count[self.of[c]] += 1
        return (sum(count.values()), min(count, key=lambda k: (-count[k], k))) if count else (0, 0)

    def learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
        self.chars.add(np.fromiter(map(len, words), np.int64, len(words)))
        letters, script = zip(*map(self._letters, words), strict=True)
        self.letters.add(np.array(letters))
        self.script.add(np.array(script))
        for encoder, (ids, start, count, partial) in zip(self.encoders, self.tokens, strict=True):
            got = encoder.encode(words)
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))
            first = np.cumsum(n) - n
            start.add(first + ids.n)
            count.add(n)
            ends = np.concatenate([[0], np.cumsum(encoder.partial[flat])])
            partial.add(ends[first + n] - ends[first])
            ids.add(flat)


def repeated_positions(word: np.ndarray, doc: np.ndarray, kinds: int, docs: int) -> np.ndarray:
    """Which words stand in a window of three that their text has twice or more; `word` and `doc` number each word and its text."""
    hit = np.zeros(len(word), bool)
    if len(word) < 3:
        return hit
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    if kinds**3 * docs >= 1 << 62:
        _, word = np.unique(word, return_inverse=True)
        kinds = int(word.max()) + 1
    key = word[inside] * kinds + word[inside + 1]
    if kinds**3 * docs >= 1 << 62:
        _, key = np.unique(key, return_inverse=True)
        key = key * kinds + word[inside + 2]
        _, key = np.unique(key, return_inverse=True)
        key = key * docs + doc[inside]
    else:
        key = (key * kinds + word[inside + 2]) * docs + doc[inside]
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        at = inside[again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key]
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return hit


def _entropies(word: np.ndarray, doc: np.ndarray, docs: int, tokens: tuple, size: int) -> np.ndarray:
    """The entropy in bits of each text's tokens."""
    ids, start, count, _ = (c.data[: c.n] for c in tokens)
    out = np.zeros(docs)
    for a in range(0, len(word), 1 << 19):
        w = word[a : a + (1 << 19)]
        n = count[w]
        skip = np.repeat(start[w] - (np.cumsum(n) - n), n)
        got = np.bincount(np.repeat(doc[a : a + (1 << 19)], n) * size + ids[skip + np.arange(len(skip))], minlength=docs * size)
        times = got if a == 0 else times + got
    if len(word):
        full = np.flatnonzero(times)
        c = times[full].astype(np.float64)
        total = np.bincount(full // size, weights=c, minlength=docs)
        out = np.where(total > 0, np.log2(np.maximum(total, 1)) - np.bincount(full // size, weights=c * np.log2(c), minlength=docs) / np.maximum(total, 1), 0)
    return np.maximum(out, 0)


def _measure(data: list[bytes], known: _Words) -> list[np.ndarray]:
    """The counts, script number, and for each vocabulary tokens, partial tokens and entropy of some texts."""
    parts = [d.split() for d in data]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = list(chain.from_iterable(parts))
    new = set(flat).difference(known.number)
    if new:
        known.learn(sorted(new))
    word = np.fromiter(map(known.number.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(data)), n)
    ends = np.cumsum(n)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[ends] - sums[ends - n]

    lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
    out = [
        n, total(known.chars.data[word]), np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in data]),
        np.array([len(x) - len(set(x)) for x in lines]), total(repeated_positions(word, doc, len(known.number), len(data))),
    ]
    kinds = max(len(known.scripts), 1)
    letters = np.bincount(doc * kinds + known.script.data[word], weights=known.letters.data[word], minlength=len(data) * kinds).reshape(len(data), kinds)
    out.append(np.where(letters.max(1) > 0, letters.argmax(1), -1))
    for encoder, tokens in zip(known.encoders, known.tokens, strict=True):
        out += [total(tokens[2].data[word]), total(tokens[3].data[word]), _entropies(word, doc, len(data), tokens, len(encoder.partial))]
    return out


def measure(docs: DataFrame, vocabularies: Sequence[Vocabulary]) -> DataFrame:
    """Add what is counted in every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, script, and for each
    vocabulary <name>_tokens, <name>_bytes (tokens that hold a piece of a character only) and <name>_entropy (bits a token).

    Words are encoded one by one, so white space has no tokens and each distinct word is encoded once. The script is that of most
    letters; a text without letters has none (null). A null text counts as empty. Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabularies))
    kinds = [(c, "long") for c in _COUNTS] + [("script", "string")]
    for v in vocabularies:
        kinds += [(f"{v.name}_tokens", "long"), (f"{v.name}_bytes", "long"), (f"{v.name}_entropy", "double")]
    docs = docs.drop(*[c for c, _ in kinds])
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders, scripts, of = [_Encoder(v) for v in shared.value], {}, {}
        known = _Words(encoders, scripts, of)
        for texts in columns:
            texts, out, k = texts.cast(pa.binary()), [[] for _ in kinds], 0
            while k < len(texts):
                data, size = [], 0
                while k < len(texts) and len(data) < SLICE_TEXTS and size < SLICE_BYTES:
                    data.append(texts[k].as_py() or b"")
                    size += len(data[-1])
                    k += 1
                for col, x in zip(out, _measure(data, known), strict=True):
                    col.extend(x.tolist())
                if len(known.number) > CACHE_WORDS:
                    known = _Words(encoders, scripts, of)
            names = [None if s < 0 else list(scripts)[s] for s in out[len(_COUNTS)]]
            out[len(_COUNTS)] = names
            yield pa.StructArray.from_arrays([pa.array(x, arrow[t]) for x, (_, t) in zip(out, kinds, strict=True)], names=[c for c, _ in kinds])

    name = fresh(docs, "told")
    told = F.arrow_udf(run, ", ".join(f"{c} {t}" for c, t in kinds))(F.col("text"))
    return docs.withColumn(name, told).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{name}.{c}").alias(c) for c, _ in kinds])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measures(name: str) -> dict[str, Column]:
    """Thousandths of characters a token, of the share of byte tokens, and of the entropy, of a vocabulary."""
    tokens = F.greatest(F.col(f"{name}_tokens"), F.lit(1))
    part = lambda x: F.floor(1000 * x / tokens + 0.5)
    return {"chars": part(F.col("word_chars")), "bytes": part(F.col(f"{name}_bytes")), "entropy": F.floor(1000 * F.col(f"{name}_entropy") + 0.5)}


def _class() -> Column:
    """Texts of n words are compared with texts of half to twice as many: entropy grows with length."""
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")


def bands(measured: DataFrame, names: Sequence[str], by: Column) -> DataFrame:
    """(kind, bands): for each value of `by` the bands of its length classes with LEAST_DOCS documents or more, as an array of
    (class, low, high); low and high hold one number for each vocabulary and measure.

    Only documents count that keep the base rules; a null `by` has no band. Measures are whole thousandths, so an exact
    percentile holds a bounded number of counts, which tasks add up before anything is shuffled.
    """
    values = {f"{v}_{m}": c for v in names for m, c in measures(v).items()}
    rows = measured.where(~base_failed()).select(by.alias("kind"), _class().alias("class"), *[c.alias(k) for k, c in values.items()]).where("kind is not null")
    quartiles = rows.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(k, F.array(F.lit(0.25), F.lit(0.75))).alias(k) for k in values])

    def edge(k: str, side: int) -> Column:
        width = REACH * F.greatest(F.col(k)[1] - F.col(k)[0], F.lit(float(LEAST_SPREAD[k.rsplit("_", 1)[1]])))
        return F.col(k)[1] + width if side else F.col(k)[0] - width

    band = F.struct("class", F.array(*[edge(k, 0) for k in values]).alias("low"), F.array(*[edge(k, 1) for k in values]).alias("high"))
    return quartiles.where(F.col("n") >= LEAST_DOCS).groupBy("kind").agg(F.sort_array(F.collect_list(band)).alias("bands"))


def judge(docs: DataFrame, vocabularies: Sequence[Vocabulary], lang: str = "lang") -> DataFrame:
    """Add to every document what `measure` counts, base_failed, kept and reasons.

    A document is kept if it keeps the base rules and every measure of every vocabulary lies within the band of the nearest
    length class of its language; a language with too few documents, or a null one, is judged by its script's, and where that has too few as
    well, only the base rules count. `reasons` names the measures outside, comma-joined. Bands come from all documents.
    Extra columns pass, those named like new ones are replaced; the text goes.
    """
    names = [v.name for v in vocabularies]
    measured = materialize(measure(docs.drop("base_failed", "kept", "reasons"), vocabularies).drop("text"))
    by_lang, by_script = (materialize(bands(measured, names, F.col(c))) for c in (lang, "script"))
    kind, own, wide = (fresh(measured, x) for x in ("kind", "own", "wide"))
    both = (
        measured.join(by_lang.toDF(f"{kind}1", own), F.col(lang) == F.col(f"{kind}1"), "left")
        .join(by_script.toDF(f"{kind}2", wide), F.col("script") == F.col(f"{kind}2"), "left")
    )
    nearest = F.array_min(F.transform(F.coalesce(own, wide), lambda b: F.struct(F.abs(b["class"] - _class()).alias("d"), b.alias("b"))))["b"]
    out = []
    for k, (v, m, c) in enumerate((v, m, c) for v in names for m, c in measures(v).items()):
        out.append(F.when((c < nearest["low"][k]) | (c > nearest["high"][k]), F.lit(f"{v}_{m}")))
    reasons = F.when(base_failed(), F.lit("base")).otherwise(F.concat_ws(",", *out))
    return both.select(
        *[F.col(f"`{c}`") for c in measured.columns], base_failed().alias("base_failed"), (reasons == "").alias("kept"), reasons.alias("reasons")
    )


def report(docs: DataFrame, vocabularies: Sequence[Vocabulary]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the measures behind the verdict, for every document (doc_id, text, lang)."""
    told = judge(docs.select("doc_id", "text", "lang"), vocabularies)
    more = [f"{v.name}_{x}" for v in vocabularies for x in ("tokens", "bytes", "entropy")]
    return told.select("doc_id", *_COUNTS, "base_failed", "kept", "reasons", "script", *more)
