"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of documents."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _MULT)]), dtype=np.uint64)
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], times the inverse power i, a polynomial hash of data[i:j]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=out[1:], dtype=np.uint64)
    return out


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle) of every distinct word shingle of each text, by owner and shingle.

    A-Z are lower-cased; words are runs of bytes other than blank and 9-13. A text with fewer than WORDS words gives its
    whole sequence as one shingle; one without words gives none.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = _LOWER[data]
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    total = prefix_hash(data)
    _, down = powers(len(data))
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    # shingles of WORDS words, and one of all words for shorter texts
    at = np.arange(len(words) - WORDS + 1) if len(words) >= WORDS else np.empty(0, np.int64)
    at = at[owner[at] == owner[at + WORDS - 1]]
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        value += words[at + k] * _STEP[k]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    few = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        some = count[short] > k
        few[some] += words[first[short][some] + k] * _STEP[k]
    few += count[short].astype(np.uint64) * _STEP[WORDS]
    who = np.concatenate([owner[at], short])
    value = mix(np.concatenate([value, few]))
    order = np.lexsort((value, who))
    who, value = who[order], value[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    return who[fresh], value[fresh]
