"""Byte-level BPE and packing against the tokenizer libraries."""

import base64
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from palmleaf.llm import bpe, packing
from palmleaf.llm import queries as Q

from . import corpus

RANKS = Q.vocabulary(Q.RANKS)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(4)
    alphabet = "abcté ç \x1c\x85\n\t  'sdll12٣日本𝒳😀<|endoftext|>!?​́"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>", "z" * 3000, " " * 500, "ab" * 700, "don't I'LL we've"]


def test_bpe_is_the_librarys(spark, encoding):
    items = odd_texts() + [None, ""]
    df = corpus.frame(spark, items)
    got = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    for r in got.collect():
        text = items[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["spans"] == "old"
    assert bpe.round_trip_digests(corpus.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_very_long_texts_and_repeated_ids(spark, encoding):
    items = ["don't été 12 " * 40_000, "z" * 50_000, "one text"]
    df = corpus.frame(spark, items)
    rows = bpe.encode(df.unionByName(df), RANKS, public_tokenizers.PATTERN).select("doc_id", "ids").collect()
    want = [encoding.encode_ordinary(t) for t in items]
    assert sorted(r["doc_id"] for r in rows) == [0, 0, 1, 1, 2, 2]
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] for r in rows)


def test_merges_are_leftmost_and_lowest():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"ab": 299, b"aaa": 301, b"aaaa": 302}
    assert bpe.merge_piece(b"aaab", ranks) == [300, 299]
    assert bpe.merge_piece(b"aaaaa", ranks) == [300, 301]
    assert bpe.merge_piece(b"", ranks) == []


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé日😀\0 "])
def test_merger_equals_single_pieces(alphabet):
    """Many pieces merged together, of all size classes, give what each gives alone."""
    ranks = bpe.load_ranks(RANKS)
    rng = random.Random(5)
    pieces = ["".join(rng.choices(alphabet, k=n)) for n in range(1, 90) for _ in range(5)]
    for piece, packed in bpe.Merger(ranks).encode(pieces).items():
        ids = bpe.merge_piece(piece.encode(), ranks)
        assert packed == struct.pack(f"<{len(ids)}I", *ids)


def test_pack_lengths():
    r = random.Random(2)
    for _ in range(60):
        lengths = [r.choice([0, 1, 5, 63, 64, r.randint(1, 64)]) for _ in range(r.randint(0, 40))]
        got = packing.pack_lengths(lengths, 64)
        totals = [sum(n for _, _, n in seq) for seq in got]
        assert all(t == 64 or (t < 64 and t & (t - 1) == 0 and t) for t in totals) and sum(totals) == sum(lengths)
        pieces = sorted(p for seq in got for p in seq)
        at = {}
        for item, start, n in pieces:
            assert start == at.get(item, 0)
            at[item] = start + n
        assert {k: v for k, v in at.items()} == {k: n for k, n in enumerate(lengths) if n}


@pytest.mark.parametrize("group", [512, 7])
def test_pack(spark, group):
    words = Q.vocabulary(Q.WORDS).decode()
    items = corpus.texts(3) + odd_texts()[:150] + ["ta re, " * 9000, "Σ ΑΣ. é! µ…, x", None]
    got = packing.pack(corpus.frame(spark, items), words, docs_per_group=group).collect()
    tokenizer = Tokenizer.from_str(words)
    ids = [np.asarray([*tokenizer.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in items]
    by_doc, by_seq = {}, {}
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, want in [(p, len(ids[d])) for d, p in by_doc.items()] + [(p, None) for p in by_seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert want in (None, at) and (want or at <= 4096)
    assert len(by_doc) == len(items)
    for parts in by_seq.values():
        total = sum(n for _, n in parts)
        assert total == 4096 or total & (total - 1) == 0


def test_pack_edges(spark):
    words = Q.vocabulary(Q.WORDS).decode()
    assert packing.pack(corpus.empty(spark), words).count() == 0
    got = packing.pack(corpus.frame(spark, ["a b", "a b", None], [1, 1, None]), words).collect()
    assert sum(r["length"] for r in got) == 7


def test_pack_by_another_tokenizer(spark):
    """One that keeps case is applied to whole texts."""
    data = json.loads(Q.vocabulary(Q.WORDS))
    assert packing._by_words(data)
    data["normalizer"]["normalizers"] = [n for n in data["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    assert not packing._by_words(data)
    words, items = json.dumps(data), ["One Two's three", None, "EIN Wort, zwei"]
    tokenizer = Tokenizer.from_str(words)
    got = packing.pack(corpus.frame(spark, items), words).collect()
    totals = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert totals == {k: len(tokenizer.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in enumerate(items)}
