"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and chunks of words that a worker remembers; beyond that the newer half goes, as the frequent ones come first. Changes no result.
CACHE_WORDS = 700_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MARKS = ".,!?#$%&*"
_LETTERS = "A-Za-zß-öø-ÿÀ-ÖØ-Þ"
#: A run of letters up to a blank or a mark, a run of marks after letters or blanks and up to a blank, or else all up to a blank.
_CHUNKS = re.compile(rf"[{_LETTERS}]+(?![^ \n\t\r{_MARKS}])|(?<![^{_LETTERS} \n\t\r])[{_MARKS}]+(?![^ \n\t\r])|[^ \n\t\r]+").findall
_WORDS = re.compile(r"[^ \n\t\r]+").findall
#: What Python takes for blanks and the tokenizer does not.
_ODD_BLANKS = re.compile("[\x1c-\x1f]").search
_PLAIN = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+").fullmatch
# Fixed value: how the tokenizers split that may be applied word by word; see _by_words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, tuple] = {}


def _tokenizer(data: str) -> tuple:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data)
        suffix = json.loads(data)["model"].get("end_of_word_suffix") or "\0"
        last = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        last[[v for k, v in tokenizer.get_vocab().items() if k.endswith(suffix)]] = True
        _loaded[key] = (tokenizer, {} if _by_words(json.loads(data)) else None, last)
    return _loaded[key]


def _by_words(data: dict) -> bool:
    """Whether a tokenizer is of the kind whose ids of a text are those of its words, and of a word those of its chunks: it
    lower-cases, makes white space one, drops it between pieces that hold letters or marks only, and puts nothing around a text."""
    parts = ((data.get("normalizer") or {}).get("normalizers"), (data.get("pre_tokenizer") or {}).get("pretokenizers"))
    if data.get("post_processor") is not None or data.get("truncation") is not None or not all(parts):
        return False
    normal, cut = parts
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and cut[0]["pattern"] == {"Regex": _SPLIT} and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        and data["model"]["type"] == "BPE" and bool(data["model"].get("end_of_word_suffix"))
    )


def _is_latin(x: str) -> bool:
    try:
        x.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _learn(fresh: list[str], tokenizer, known: dict[str, bytes], last: np.ndarray) -> None:
    """Add the ids of new chunks, as packed 32-bit integers. Plain chunks are words each, so many go in one call and the
    ids of word ends tell them apart; the others go one by one."""
    plain = [w for w in fresh if _PLAIN(w)]
    for k in range(0, len(plain), 2048):
        part = plain[k : k + 2048]
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(part) or ends[-1] != len(ids):
            break
        data, at = ids.tobytes(), 0
        for word, end in zip(part, (ends * 4).tolist(), strict=True):
            known[word] = data[at:end]
            at = end
    rest = [w for w in fresh if w not in known]
    for k in range(0, len(rest), 2048):
        part = rest[k : k + 2048]
        for word, got in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)


def _holes(ids: list) -> list[int]:
    """Where a list has None."""
    out, at, find = [], -1, ids.index
    try:
        while True:
            out.append(at := find(None, at + 1))
    except ValueError:
        return out


def _ids(texts: list[str], tokenizer, words: dict[str, bytes] | None, last: np.ndarray, end: bytes) -> list[bytes]:
    """The ids of each text and the closing id, as packed 32-bit integers. Without `words`, whole texts go to the tokenizer.

    Otherwise it lower-cases, drops white space, and lets no token cross it or the border between a run of Latin letters
    and an ASCII mark. So a text's ids are those of its words in order, a word's those of its chunks, and each distinct one
    is encoded once.
    """
    if words is None:
        return [np.asarray(got.ids, "<u4").tobytes() + end for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    split = []
    for x in texts:
        # Latin-1 text has no characters that combine and lower-cases character by character
        plain = x.isascii() or _is_latin(x)
        split.append(x.lower().split() if plain and not _ODD_BLANKS(x) else _WORDS(x))
    got = [list(map(words.get, part)) for part in split]
    holes = [_holes(ids) for ids in got]
    fresh = {part[i] for part, missing in zip(split, holes, strict=True) for i in missing}
    if fresh:
        chunks = {w: _CHUNKS(w) for w in fresh}
        new = {c for part in chunks.values() for c in part if c not in words}
        if new:
            _learn(list(new), tokenizer, words, last)
        for w, part in chunks.items():
            if len(part) > 1:
                words[w] = b"".join([words[c] for c in part])
    out = []
    for part, ids, missing in zip(split, got, holes, strict=True):
        for i in missing:
            ids[i] = words[part[i]]
        out.append(b"".join(ids) + end)
    if len(words) > CACHE_WORDS:
        for w in list(words)[CACHE_WORDS // 2 :]:
            del words[w]
    return out


class _Bins:
    """Free room of each bin under a tournament tree that finds the first bin with enough of it."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.tree[self.size : self.size + n] = [room] * n
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def put(self, need: int) -> int:
        tree, k = self.tree, 1
        while k < self.size:
            k *= 2
            if tree[k] < need:
                k += 1
        found = k - self.size
        tree[k] -= need
        while k := k >> 1:
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return found


def pack_lengths(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length): no sequence exceeds `room`; all are full or of a power of two.

    First-fit decreasing places whole items. The emptiest bins then give their items, cut where needed, to fill
    the gaps of the fuller ones, and what is left in the last open bin is cut at powers of two, so nothing is padded.
    `room` has to be a power of two. Ties go by item number.
    """
    order = sorted((k for k, n in enumerate(lengths) if n > 0), key=lambda k: (-lengths[k], k))
    tree, bins = _Bins(len(order), room), []
    for k in order:
        at = tree.put(lengths[k])
        if at == len(bins):
            bins.append([])
        bins[at].append((k, 0, lengths[k]))
    used = [sum(x[2] for x in b) for b in bins]
    by_fill = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    left, right = 0, len(by_fill) - 1
    while left < right:
        to, giver = by_fill[left], by_fill[right]
        if used[to] == room:
            left += 1
        elif not used[giver]:
            right -= 1
        else:
            item, start, n = bins[giver].pop()
            take = min(n, room - used[to])
            bins[to].append((item, start + n - take, take))
            if take < n:
                bins[giver].append((item, start, n - take))
            used[to] += take
            used[giver] -= take
    out = [b for b, n in zip(bins, used, strict=True) if n == room]
    for rest in (b for b, n in zip(bins, used, strict=True) if 0 < n < room):
        parts = list(rest)
        total = sum(x[2] for x in parts)
        for bit in range(total.bit_length() - 1, -1, -1):
            need, seq = total & 1 << bit, []
            while need:
                item, start, n = parts.pop()
                take = min(n, need)
                seq.append((item, start, take))
                if take < n:
                    parts.append((item, start + take, n - take))
                need -= take
            if seq:
                out.append(seq)
    return out


def pack(docs: DataFrame, tokenizer_json: str, max_tokens: int = 4096, end_id: int = 2, docs_per_group: int = 512) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `max_tokens` (a power of two) tokens: one row (`PIECES`) per piece.

    A document's tokens are its text's ids and `end_id`; a null text counts as empty, so every document has a token.
    Stretches of `max_tokens` from a document's start become sequences of their own map-side; only the remainders
    meet, in groups of about `docs_per_group` documents dealt by a hash of doc_id (the group count follows the
    number of documents, so a group's size does not grow with the corpus). Extra columns are ignored; repeated
    doc_ids are packed like other documents; an empty table gives no rows. The tokenizer is broadcast. One of the kind that
    `_by_words` knows is applied to distinct words, any other to whole texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    groups = max(1, -(-docs.count() // docs_per_group))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    names = ["grp", "doc_id", "start", "length", "crc", "doc_tokens", "ids"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words, last = _tokenizer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for group, doc, ids in zip(part.column(2).to_pylist(), part.column(0).to_pylist(), _ids(texts, tokenizer, words, last, end), strict=True):
                    n, step = len(ids) // 4, max_tokens * 4
                    full = n // max_tokens
                    for j in range(full):
                        rows.append((group, doc, j * max_tokens, max_tokens, zlib.crc32(ids[j * step : (j + 1) * step]), n, None))
                    if n > full * max_tokens:
                        rest = np.frombuffer(ids, "<u4", offset=full * step)
                        short = rest.astype("<u2") if rest.max() < 1 << 16 else rest
                        rows.append((group, doc, full * max_tokens, n - full * max_tokens, None, n, short.tobytes()))
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable")
        base, seq, rows = int(key[0]) << 32, 0, []
        whole = pdf[pdf["ids"].isna()]
        for doc, start, n, crc, total in zip(whole["doc_id"], whole["start"], whole["length"], whole["crc"], whole["doc_tokens"], strict=True):
            rows.append((doc, start, n, int(crc), total, base + seq, 0))
            seq += 1
        rest = pdf[pdf["ids"].notna()]
        docs_, starts, totals = rest["doc_id"].tolist(), rest["start"].tolist(), rest["doc_tokens"].tolist()
        lengths = rest["length"].tolist()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(rest["ids"], lengths, strict=True)]
        for pieces in pack_lengths(lengths, max_tokens):
            offset = 0
            for item, at, n in pieces:
                crc = zlib.crc32(ids[item][at : at + n].tobytes())
                rows.append((docs_[item], starts[item] + at, n, crc, totals[item], base + seq, offset))
                offset += n
            seq += 1
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("grp"))
    rows = dealt.mapInArrow(tokens, "grp long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary")
    # about 64 groups a task, however many there are
    if groups > 64 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(-(-groups // 64), "grp")
    return rows.groupBy("grp").applyInPandas(fill, PIECES)
