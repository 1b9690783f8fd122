"""Quality rules by tokeniser fertility against plain counting and the vocabularies' own libraries."""

import base64
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from palmleaf.llm import quality_rules as R
from palmleaf.llm.queries import PIECES, RANKS, vocabulary

from . import corpus

VOCABULARIES = [R.Vocabulary("piece", vocabulary(PIECES)), R.Vocabulary("byte", vocabulary(RANKS), public_tokenizers.PATTERN)]
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
ODD = [
    None, "", " \n ", "word", "a b c a b c a b", "x\n\nx\n x\nx", "#$%&| <a>*", "a b\x85c d e", "你好 世界 你好", "Привет мир, привет", "日本語 テキスト abc", "🙂🙃 \U0001f468‍\U0001f469", "é é ﬁ ▁x",
    "\x00 \x1f a", "z" * 20000, "ab " * 5000, "1 2 3 4 5", "ሴላ ሴላም", "a a a a",
]


def base(text):
    words = WORDS(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def script(text):
    count = Counter()
    for w in WORDS(text or ""):
        own = Counter(unicodedata.name(c, "NONE").split(" ")[0] for c in w if c.isalpha())
        if own:
            count[own.most_common(1)[0][0]] += sum(own.values())
    return count


def plain_tokens(text, encode, partial):
    got = [t for w in WORDS(text or "") for t in encode(w)]
    n = Counter(got)
    return len(got), sum(map(partial, got)), -sum(c / len(got) * math.log2(c / len(got)) for c in n.values())


def test_measures(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_TEXTS", 3)
    items = corpus.texts() + ODD
    got = {r["doc_id"]: r for r in R.measure(corpus.frame(spark, items).withColumn("n_words", F.lit("old")), VOCABULARIES).collect()}
    assert len(got) == len(items) and all(r["spans"] == "old" for r in got.values())
    model = sentencepiece.SentencePieceProcessor(model_proto=VOCABULARIES[0].data)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARIES[1].data.splitlines())}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(t):
        try:
            return coder.decode_single_token_bytes(t).decode() is None
        except UnicodeDecodeError:
            return True

    for k, text in enumerate(items):
        r = got[k]
        assert tuple(r[c] for c in R._COUNTS) == base(text), text
        scripts = script(text)
        assert r["script"] == (None if not scripts else r["script"]) and (not scripts or scripts[r["script"]] == max(scripts.values()))
        for name, encode, partial in (("piece", model.encode, model.is_byte), ("byte", lambda w: coder.encode_ordinary(f" {w}"), whole)):
            n, b, h = plain_tokens(text, encode, partial)
            assert (r[f"{name}_tokens"], r[f"{name}_bytes"]) == (n, b) and abs(r[f"{name}_entropy"] - h) < 1e-9, (name, text)


@pytest.mark.parametrize("kinds", [4, 1 << 21])
def test_repeated_positions(kinds):
    """Equal windows of different texts don't count, with keys of one step and of two."""
    r = np.random.default_rng(kinds)
    word, doc = r.integers(0, 4, 300) * (kinds // 4), np.sort(r.integers(0, 9, 300))
    got = R.repeated_positions(word, doc, kinds, 9)
    for d in range(9):
        mine = word[doc == d].tolist()
        n = Counter(zip(mine, mine[1:], mine[2:], strict=False))
        want = {k + j for k, w in enumerate(zip(mine, mine[1:], mine[2:], strict=False)) if n[w] > 1 for j in range(3)}
        assert np.flatnonzero(got[doc == d]).tolist() == sorted(want)


def documents(seed=4):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        lang = ["en", "xx", None, "ru"][k % 4]
        letters = "абвгдежзик" if lang == "ru" else "etaoinshrd"
        words = ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(r.randint(60, 250))]
        if k % 40 == 0:
            words = [w + r.choice(["&&&", "$$$", "%%%"]) for w in words]
        elif k % 40 == 1:
            words = ["".join(r.choices("🜁🜂🜃🜄𐎀𐎁𐎂𐎃", k=3)) for _ in words]
        rows.append((k, " ".join(words), lang))
    return rows + [(400, None, "en"), (401, "", None), (402, "few words", "en"), (403, " ".join(["the same again"] * 60), "en"), (404, documents_rare(), "rare")]


def documents_rare():
    return " ".join(chr(0x4E00 + 7 * k) + chr(0x4E00 + 11 * k) for k in range(80))


def test_verdicts(spark, monkeypatch):
    """Bands by language and length from exact quartiles; a null language goes by its script; rare ones keep the base rules only."""
    monkeypatch.setattr(R, "LEAST_DOCS", 20)
    rows = documents()
    got = {r["doc_id"]: r for r in R.judge(spark.createDataFrame([(*x, "old", "old") for x in rows], "doc_id long, text string, lang string, kept string, own string"), VOCABULARIES).collect()}
    assert len(got) == len(rows) and all(r["own"] == "old" for r in got.values())

    def values(r):
        tokens = lambda v: max(r[f"{v}_tokens"], 1)
        return [f for v in ("piece", "byte") for f in (math.floor(1000 * r["word_chars"] / tokens(v) + 0.5), math.floor(1000 * r[f"{v}_bytes"] / tokens(v) + 0.5), math.floor(1000 * r[f"{v}_entropy"] + 0.5))]

    good = [r for r in got.values() if not r["base_failed"]]
    bands = {}
    for by in ("lang", "script"):
        for kind in {r[by] for r in good} - {None}:
            for size in {int(math.log2(r["n_words"])) for r in good}:
                mine = [values(r) for r in good if r[by] == kind and int(math.log2(r["n_words"])) == size]
                if len(mine) >= 20:
                    q1, q3 = np.percentile(np.array(mine), [25, 75], axis=0)
                    wide = 3 * np.maximum(q3 - q1, [100, 10, 150] * 2)
                    bands.setdefault((by, kind), {})[size] = (q1 - wide, q3 + wide)
    assert ("lang", "en") in bands and ("script", "LATIN") in bands and ("lang", "rare") not in bands
    rejected = 0
    for r in got.values():
        n = r["n_words"]
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        mine = bands.get(("lang", r["lang"])) or bands.get(("script", r["script"]))
        want = not r["base_failed"]
        if want and mine:
            low, high = mine[min(mine, key=lambda s: (abs(s - int(math.log2(n))), s))]
            want = bool(np.all((low <= values(r)) & (values(r) <= high)))
            rejected += not want
        assert r["kept"] == want and (r["reasons"] == "") == want, r
    # junk glued to words and rare symbols go, prose and the rare language stay
    assert all(not got[k]["kept"] for k in range(400) if k % 40 in (0, 1)) and rejected == 20 and got[404]["kept"]
    assert all(got[k]["kept"] for k in range(400) if k % 40 not in (0, 1))


def test_edges(spark):
    assert R.report(corpus.empty(spark), VOCABULARIES).count() == 0
    rows = R.report(corpus.frame(spark, ["one two"] * 3 + [None], [None, 1, 1, 1]), VOCABULARIES).collect()
    assert [r["base_failed"] for r in rows] == [True] * 4 and not any(r["kept"] for r in rows) and {r["reasons"] for r in rows} == {"base"}
