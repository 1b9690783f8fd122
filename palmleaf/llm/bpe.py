"""Byte-level BPE encoding and decoding with a segment tree of pair ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = 1 << 62
#: Pieces a worker remembers; beyond that the newer half goes, as the frequent ones come first. Changes no result.
CACHE_PIECES = 300_000
#: Longer pieces aren't remembered, so the memory is bounded in bytes too.
CACHE_CHARS = 64
#: Characters of texts that are split before their new pieces are merged together.
GROUP_CHARS = 500_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    The leaf at byte i holds the rank of the pair that starts at the live symbol i; each inner node holds
    the smaller of its children, so a walk that prefers the left child finds the leftmost minimum. A merge
    changes three leaves, each in logarithmic time.
    """
    if not piece:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    level = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
    size = 1 << (n - 1).bit_length()
    level += [_NONE] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree.insert(0, _NONE)  # the root is entry 1, and entry k has the children 2k and 2k + 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != _NONE:
        at = 1
        while at < size:
            at *= 2
            if tree[at] != best:
                at += 1
        at -= size
        gone = after[at]
        end = after[at] = after[gone]
        prev = before[at]
        if end < n:
            before[end] = at
            changes = ((gone, _NONE), (at, get(piece[at : after[end]], _NONE)))
        else:
            changes = ((gone, _NONE), (at, _NONE))
        if prev >= 0:
            changes += ((prev, get(piece[prev:end], _NONE)),)
        for leaf, rank in changes:
            k = leaf + size
            tree[k] = rank
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < rank:
                    rank = other
                if tree[k] == rank:
                    break
                tree[k] = rank
    out, at = [], 0
    while at < n:
        end = after[at]
        out.append(ranks[piece[at:end]])
        at = end
    return out


class Merger:
    """Encodes many pieces at once: their segment trees are rows of one matrix, and each step takes one merge in every piece
    that has one left. Results are those of `merge_piece`, which long pieces go through one by one."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        self.ranks = ranks
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = sorted(
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := get(token[:at])) is not None and (right := get(token[at:])) is not None
        )
        table = np.array([*pairs, (_NONE, -1)], np.int64)
        self.keys, self.values = table[:, 0].copy(), table[:, 1].copy()

    def keys_at(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of pairs of symbols that start at `at`: rank and place in one number, so a minimum is the leftmost of its rank."""
        pair = left << 32 | right
        found = np.searchsorted(self.keys, pair)
        return np.where(self.keys[found] == pair, self.values[found] << 6 | at, _NONE)

    def encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids by piece."""
        out, classes = {}, {8: [], 16: [], 32: [], 64: []}
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = struct.pack("<I", whole)
            elif len(data) > 64 or self.single.min() < 0:
                ids = merge_piece(data, self.ranks)
                out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                classes[max(8, 1 << (len(data) - 1).bit_length())].append((piece, data))
        for size, part in classes.items():
            for k in range(0, len(part), 4096):
                some = part[k : k + 4096]
                out.update(zip([x for x, _ in some], self._merge([d for _, d in some], size), strict=True))
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, place = len(pieces), np.arange(size)
        length = np.array([len(p) for p in pieces], np.int64)
        symbols = self.single[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)].reshape(m, size)
        live = place < length[:, None]
        tree = np.full((m, 2 * size), _NONE, np.int64)
        tree[:, size:-1] = np.where(live[:, 1:], self.keys_at(symbols[:, :-1], symbols[:, 1:], place[:-1]), _NONE)
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        tree, flat, alive, after, before = tree.ravel(), symbols.ravel(), live.ravel(), after.ravel(), before.ravel()
        while len(rows):
            row, best = rows * size, tree[2 * size * rows + 1]
            at = best & 63
            gone = after[row + at]
            end, prev = after[row + gone], before[row + at]
            flat[row + at] = best >> 6
            alive[row + gone] = False
            after[row + at] = end
            more = end < length[rows]
            before[(row + end)[more]] = at[more]
            right, left = np.where(more, end, 0), np.maximum(prev, 0)
            here = np.where(more, self.keys_at(flat[row + at], flat[row + right], at), _NONE)
            root = 2 * row + size
            tree[root + gone] = _NONE
            tree[(root + prev)[prev >= 0]] = self.keys_at(flat[row + left], flat[row + at], left)[prev >= 0]
            tree[root + at] = here
            base = np.concatenate([2 * row] * 3)
            node = np.concatenate([gone, at, left]) + size
            while node[0] > 1:
                node >>= 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree[below], tree[below + 1])
            rows = rows[tree[2 * size * rows + 1] != _NONE]
        data = flat[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.reshape(m, size).sum(1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_loaded: dict[str, tuple] = {}


def _vocabulary(data: bytes) -> tuple:
    """The merger, the worker's memory of pieces, and the bytes of each id."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        ranks = load_ranks(data)
        _loaded[key] = (Merger(ranks), {}, {v: k for k, v in ranks.items()})
    return _loaded[key]


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(column, kind)])


def _groups(texts: list) -> Iterator[list[str]]:
    """Texts in order, together up to GROUP_CHARS characters; a longer one stands alone. Nulls are empty texts."""
    group, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _encoded(texts: list, merger: Merger, pieces: dict[str, bytes], find) -> list[bytes]:
    get, out = pieces.__getitem__, []
    for group in _groups(texts):
        split = [find(text) for text in group]
        fresh = set(chain.from_iterable(split)).difference(pieces)
        pieces.update(merger.encode(list(fresh)))
        out += [b"".join(map(get, part)) for part in split]
        for piece in fresh:
            if len(piece) > CACHE_CHARS:
                del pieces[piece]
        if len(pieces) > CACHE_PIECES:
            for piece in list(pieces)[CACHE_PIECES // 2 :]:
                del pieces[piece]
    return out


def _decoded(ids: list, tokens: dict[int, bytes]) -> list[bytes]:
    get = tokens.__getitem__
    return [b"".join(map(get, struct.unpack(f"<{len(x) // 4}I", x))) if x else b"" for x in ids]


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add `ids_col`: the text's token ids as little-endian unsigned 32-bit integers, in one binary value.

    `ranks` is the content of a rank file; it is broadcast, its size being that of the vocabulary. Every match of
    `pattern` is encoded separately; special tokens are ordinary text. A null text counts as empty and gives no
    ids. Other columns pass through; one named like `ids_col` is replaced. Runs map-side, without a shuffle.
    """
    df = df.drop(ids_col)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger, pieces, _ = _vocabulary(shared.value)
        find = regex.compile(pattern).findall
        for pdf in batches:
            yield pdf.assign(**{ids_col: pd.Series(_encoded(pdf[text_col].tolist(), merger, pieces, find), index=pdf.index, dtype=object)})

    return df.mapInPandas(run, _with(df, ids_col, T.BinaryType()))


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add `bytes_col`: the bytes that the ids in `ids_col` (as `encode` gives them) stand for; null ids give no bytes.

    An id without an entry in the vocabulary is an error. The bytes of a valid encoding are the UTF-8 text.
    Other columns pass through; one named like `bytes_col` is replaced.
    """
    df = df.drop(bytes_col)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, tokens = _vocabulary(shared.value)
        for pdf in batches:
            yield pdf.assign(**{bytes_col: pd.Series(_decoded(pdf[ids_col].tolist(), tokens), index=pdf.index, dtype=object)})

    return df.mapInPandas(run, _with(df, bytes_col, T.BinaryType()))


def round_trip_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: what `encode` and then `decode` give, in one pass
    that holds the ids of a few documents at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, pieces, tokens = _vocabulary(shared.value)
        find = regex.compile(pattern).findall
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids = _encoded(part.column(1).to_pylist(), merger, pieces, find)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _decoded(ids, tokens)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
