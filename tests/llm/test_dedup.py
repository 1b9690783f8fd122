"""Substring, unit, line and n-gram de-duplication against brute force."""

import hashlib
import random
import re

import pytest

import palmleaf.llm.jaccard_join as J
import palmleaf.llm.repeats as R
from palmleaf.llm import line_dedup, unit_dedup

from . import corpus

sha = lambda b: hashlib.sha256(b).hexdigest()


def keyed(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def brute_repeats(items):
    seen, out = set(), {}
    for doc, text in sorted((k, x or "") for k, x in items.items()):
        b = text.encode()
        cover = bytearray(len(b))
        for p in range(len(b) - R.LEAST + 1):
            w = b[p : p + R.LEAST]
            if w in seen:
                cover[p : p + R.LEAST] = b"\1" * R.LEAST
            seen.add(w)
        runs = sum(1 for j, c in enumerate(cover) if c and not (j and cover[j - 1]))
        out[doc] = (len(b), sum(cover), runs, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize(("seed", "limit"), [(5, 4096), (6, 2), (7, 0)])
def test_repeats(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(R, "LIMIT", limit)
    items = corpus.texts(seed)
    r = random.Random(seed)
    hub = corpus.line(r, 40)
    items += [f"{corpus.line(r, 9)} {hub[k:]} {corpus.line(r, 9)}" for k in range(12)]
    ids = r.sample(range(-50, 5000), len(items))
    got = {k: tuple(v)[1:] for k, v in keyed(R.digests(corpus.frame(spark, items, ids))).items()}
    assert got == brute_repeats(dict(zip(ids, items, strict=True)))


def test_a_frequent_anchor_is_dealt_out(spark, monkeypatch):
    """Thousands of documents with a common phrase and other text around it: no window of an anchor holds more than some LIMIT rows."""
    monkeypatch.setattr(R, "LIMIT", 128)
    r = random.Random(9)
    phrase = bytes(r.choices(range(97, 123), k=60)).decode()
    own = lambda: bytes(r.choices(range(97, 123), k=80)).decode()
    items = [f"{own()}{phrase}{own()}" for _ in range(3000)]
    items += [f"{items[5]} {items[6]}", items[7][:150]]
    df = corpus.frame(spark, items)
    hot = R.frequent_anchors(df)
    lists = R.listed(R.anchor_rows(df), hot)
    assert hot.count() > 0 and lists.where("kind = 0").groupBy("anchor", "part").count().agg({"count": "max"}).first()[0] < 4 * 128
    assert lists.where("kind = 0 and part is not null").count() >= 2500
    got = {k: tuple(v)[1:] for k, v in keyed(R.digests(df)).items()}
    assert got == brute_repeats(dict(enumerate(items)))


def test_bytes_of_rare_and_frequent_anchors(spark):
    """The bytes around rare anchors and the windows of frequent ones come from one shuffle of the texts; anchors beyond 2**53 stay as they are."""
    text = bytes(random.Random(4).choices(range(97, 123), k=400)).decode()
    kind = "anchor long, doc long, at long, back short, fore short"
    few, many = spark.createDataFrame([(2**62 + 1, 0, 150, 50, 90)], kind), spark.createDataFrame([(2**62 + 3, 0, 210, 10, 92)], kind)
    got = R.wanted_bytes(corpus.frame(spark, [text, text[:200]]), few, many)
    rows = {(r["each"], r["anchor"], r["doc"], r["at"], r["back"], bytes(r["span"])) for r in got.collect()}
    windows = {(True, 2**62 + 3, 0, p, 0, hashlib.md5(text[p : p + 100].encode()).digest()) for p in (200, 201, 202)}
    assert rows == windows | {(False, 2**62 + 1, 0, 150, 50, text[100:240].encode())}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_repeats_edges(spark):
    assert R.digests(corpus.empty(spark)).count() == 0
    df = corpus.frame(spark, ["x" * 120, "x" * 120, None], [1, 1, None])  # a repeated id, a null one
    assert R.digests(df).count() == 3
    kept = R.dedup_substrings(corpus.frame(spark, ["q" * 150, "a" + "q" * 150]), "gone", "ids")
    got = keyed(kept)
    assert bytes(got[0]["ids"]) == b"q" and bytes(got[1]["ids"]) == b"a" and got[1]["spans"] == "old"


@pytest.mark.parametrize("limit", [4096, 0])
def test_repeats_of_a_row(spark, monkeypatch, limit):
    """Equal rows of one id don't delete each other's text; later documents lose it still."""
    monkeypatch.setattr(R, "LIMIT", limit)
    r = random.Random(2)
    text, other = (bytes(r.choices(range(97, 123), k=300)).decode() for _ in range(2))
    items, ids = [text, text, "0" + text[:250] + "1", other, text], [1, 1, 2, 3, 4]
    got = R.dedup_substrings(corpus.frame(spark, items, ids), "gone", "ids").collect()
    assert sorted((x["doc_id"], bytes(x["ids"]).decode()) for x in got) == [(1, text), (1, text), (2, "01"), (3, other), (4, "")]


def test_maximal_repeat_groups():
    import numpy as np

    body = bytes(random.Random(1).choices(range(97, 123), k=160))
    spans = [b"1" + body[:150] + b"x", b"2" + body[:150] + b"y", b"3" + body[20:150] + b"z"]
    back = np.array([41, 41, 21])
    groups = list(R.repeat_groups(np.zeros(3, int), np.arange(3), np.full(3, 1000), back, [s[: 41 + 100] if k < 2 else s[: 21 + 100] for k, s in enumerate(spans)]))
    found = {(n, tuple(sorted(who.tolist()))) for n, _, who in groups}
    assert (120, (0, 1, 2)) in found and (140, (0, 1)) in found  # both maximal repeats, each with all its occurrences


BLANK = " \t\n\x0b\f\r"


def brute_cut(text, unit):
    """Character by character: where units begin and end."""
    units, at, k = [], 0, 0
    while k < len(text):
        end = k + 1
        if unit == "line" and (text[k] == "\n" or text[k] in ".!?" and text[k + 1 : k + 2] in set(BLANK)):
            while end < len(text) and text[end] in BLANK:
                end += 1
        elif unit == "paragraph" and text[k] == "\n" and (m := re.match(r"[ \t]*\n", text[k + 1 :])):
            end += m.end()
            while end < len(text) and text[end] in BLANK:
                end += 1
        else:
            k = end
            continue
        units.append((at, end))
        at = k = end
    return [*units, (at, len(text))]


def brute_words(text):
    """(lower-cased word, start, end with the blanks behind it)."""
    found = [(m.start(), m.end()) for m in re.finditer(f"[^{BLANK}]+", text)]
    ends = [a for a, _ in found[1:]] + [len(text)]
    return [(text[a:b].lower(), a, e) for (a, b), e in zip(found, ends, strict=False)]


def brute_units(items, unit, least, grow):
    """The removed spans: runs of units seen before, grown into their neighbours as far as the first occurrence of the longest unit agrees."""
    cut = {doc: brute_cut(text or "", unit) for doc, text in items.items()}
    of = lambda doc, no: brute_words(items[doc][cut[doc][no][0] : cut[doc][no][1]]) if 0 <= no < len(cut[doc]) and items[doc] else []
    seen, out = {}, {}
    for doc in sorted(items):
        again = {}
        for no in range(len(cut[doc])):
            form = tuple(w for w, *_ in of(doc, no))
            if form and form in seen:
                again[no] = (len(form), seen[form])
            elif form:
                seen[form] = (doc, no)
        spans, no = [], 0
        while no < len(cut[doc]):
            if no not in again:
                no += 1
                continue
            last = no
            while last + 1 in again:
                last += 1
            words = sum(again[k][0] for k in range(no, last + 1))
            if words >= min(unit_dedup.SEED_WORDS, least):
                top = max(range(no, last + 1), key=lambda k: (again[k][0], -k))
                source, shift = again[top][1][0], again[top][1][1] - top
                a, b = cut[doc][no][0], cut[doc][last][1]
                mine, other = of(doc, no - 1), of(source, no + shift - 1)
                n = 0
                while n < min(len(mine), len(other), grow) and mine[-1 - n][0] == other[-1 - n][0]:
                    n += 1
                if n:
                    a = cut[doc][no - 1][0] + mine[-n][1]
                mine, other = of(doc, last + 1), of(source, last + shift + 1)
                m = 0
                while m < min(len(mine), len(other), grow) and mine[m][0] == other[m][0]:
                    m += 1
                if m:
                    b = cut[doc][last + 1][0] + mine[m - 1][2]
                if words + n + m >= least:
                    if spans and a <= spans[-1][1]:
                        a, b = spans[-1][0], max(b, spans.pop()[1])
                    spans.append((a, b))
            no = last + 1
        out[doc] = spans
    return out


def without(text, spans):
    out, at = "", 0
    for a, b in spans:
        out, at = out + text[at:a], b
    return out + text[at:]


def pasted(seed=3):
    """Passages of sentences pasted into other texts between any two words, re-wrapped, and alone; short phrases that recur."""
    r = random.Random(seed)
    sentence = lambda n: corpus.line(r, n).capitalize()
    passages = [" ".join(sentence(r.randint(2, 12)) for _ in range(9)) for _ in range(4)]
    out = []
    for k in range(24):
        own = " ".join(sentence(r.randint(3, 12)) for _ in range(8)).split(" ")
        at = r.randrange(len(own))
        body = passages[k % 4] if k % 3 else passages[k % 4].replace(". ", ".\n").upper()
        out.append(" ".join([*own[:at], body, *own[at:], "See below."]))
    return [*out, *passages]


@pytest.mark.parametrize(("unit", "least", "grow"), [("line", 25, 200), ("line", 1, 200), ("paragraph", 8, 200), ("line", 40, 3)])
def test_units(spark, unit, least, grow):
    items = corpus.texts(8) + pasted()
    items += ["\n \n".join(x.split("\n")) for x in items[:20] * 2 if x] + ["\r\n a b.\n\n\t\n c. d"] * 2
    items = dict(enumerate(items))
    want = brute_units(items, unit, least, grow)
    assert sum(map(len, want.values())) > 20
    got = keyed(unit_dedup.dedup_units(corpus.frame(spark, list(items.values())), unit, least, removed_col="gone", count_col="score", grow_words=grow))
    assert {k: [(x["start"], x["finish"]) for x in v["gone"]] for k, v in got.items()} == want
    assert all(v["text"] == (items[k] if items[k] is None else without(items[k], want[k])) for k, v in got.items())
    assert got[0]["ids"] == "old"


def test_units_catch_pasted_passages(spark):
    """Every later copy of a passage goes, first and last sentence too, wherever it was pasted; own text stays."""
    items = pasted()
    got = keyed(unit_dedup.dedup_units(corpus.frame(spark, items)))
    assert all(got[k]["removed"] for k in range(4, len(items))) and not any(got[k]["removed"] for k in range(4))
    assert all("See below." in got[k]["text"] for k in range(24))
    # of a later document that had a passage pasted in, its own words are left
    for k in range(4, 24):
        passage = [w.lower() for w in items[24 + k % 4].split()]
        words = [w.lower() for w in items[k].split()]
        at = next(j for j in range(len(words)) if words[j : j + len(passage)] == passage)
        assert got[k]["text"].lower().split() == words[:at] + words[at + len(passage) :]


def test_runs_of():
    unit = lambda no, words, doc, at, ends=0: {"no": no, "words": words, "ends": ends, "first": {"doc_id": doc, "no": at}}
    got = unit_dedup.runs_of([unit(2, 3, 1, 9), unit(3, 8, 5, 4), unit(4, 8, 6, 0), unit(7, 1, 1, 0)])
    assert got == [(2, 4, 19, 5, 2, 6), (7, 7, 1, 1, -1, 1)]
    # nothing stands before a text's first unit or behind its last
    assert unit_dedup.runs_of([unit(1, 3, 1, 9, 1), unit(2, 2, 1, 10, 2)]) == [(1, 2, 5, 1, -1, -1)]


def test_units_edges(spark):
    assert unit_dedup.digests(corpus.empty(spark)).count() == 0
    text = "a line that is long enough to go, one word after another, and another, till it has as many as are asked for or more, which takes a clause like this one and then one more like it, so that nobody is left in doubt."
    got = unit_dedup.digests(corpus.frame(spark, [text] * 3 + [None, text], [1, 1, None, 2, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 1)]


def test_units_of_a_very_long_text(spark):
    r = random.Random(5)
    body = [corpus.line(r) for _ in range(200)]
    long = "\n".join([*body, "x" * 1_000_000, *["the same short line."] * 60_000])
    got = keyed(unit_dedup.digests(corpus.frame(spark, ["\n".join(body), long])))
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 200 + 59_999


def brute_lines(items, least=3, words=50):
    """By result: the numbers of all lines in runs of `least` lines that an earlier place has, and of long lines that occurred."""
    seen, gone = set(), {}
    for doc, text in sorted(items.items()):
        full = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        gone[doc] = set()
        for n, x in full:
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) > words:
                if x in seen:
                    gone[doc].add(n)
                seen.add(x)
        for k in range(len(full) - least + 1):
            run = tuple(x for _, x in full[k : k + least])
            if run in seen:
                gone[doc].update(n for n, _ in full[k : k + least])
            seen.add(run)
    return {d: sorted(x) for d, x in gone.items()}


def headed(pairs=30):
    """A document of a header only, then pairs of documents that share header and passage, bare or between own lines, and short copies."""
    r = random.Random(21)
    new = lambda n: [corpus.line(r) for _ in range(n)]
    header = new(3)
    out = [header]
    for k in range(pairs):
        body, own = header + new(3), 4 * (k % 2)
        out += [new(own) + body + new(own) for _ in range(2)]
    out += [x for _ in range(pairs // 4) for x in [header + new(1)] * 2]
    return ["\n".join(x) for x in out]


def without_lines(text, gone):
    return text if not gone else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(gone))


@pytest.mark.parametrize("least", [3, 1, 5])
def test_lines(spark, least):
    r = random.Random(4)
    four, long, short = [corpus.line(r) for _ in range(4)], corpus.line(r, 60), corpus.line(r, 20)
    items = corpus.texts(9) + headed() + ["\n".join([corpus.line(r), *four, corpus.line(r)]) for _ in range(8)]
    items += [f"{corpus.line(r)}\n{long}" for _ in range(3)] + [f"\t{short}\n{corpus.line(r)}" for _ in range(3)]
    items += ["\n".join(r.choices("abc", k=40)) for _ in range(6)]  # ties everywhere
    ids = r.sample(range(-50, 5000), len(items))
    items = dict(zip(ids, items, strict=True))
    want = brute_lines(items, least)
    assert sum(map(len, want.values())) > 200
    got = keyed(line_dedup.dedup_lines(corpus.frame(spark, list(items.values()), ids), "gone", least))
    assert {d: got[d]["gone"] for d in items} == want
    assert all(got[d]["text"] == without_lines(x, want[d]) for d, x in items.items())
    assert got[ids[0]]["spans"] == "old"


def test_lines_of_a_run_longer_than_its_first_occurrence(spark):
    """A has three lines, B those and three more, C all six of B: all of C goes, and A's of B."""
    r = random.Random(6)
    a, more = [corpus.line(r) for _ in range(3)], [corpus.line(r) for _ in range(3)]
    got = keyed(line_dedup.dedup_lines(corpus.frame(spark, ["\n".join(x) for x in (a, a + more, a + more)])))
    assert [got[k]["removed_lines"] for k in range(3)] == [[], [0, 1, 2], [0, 1, 2, 3, 4, 5]]


def test_lines_of_very_long_texts(spark):
    """Twenty thousand equal lines, as many different ones twice, and one line of megabytes."""
    r = random.Random(7)
    many = "\n".join(f"{k} {corpus.word(r)}" for k in range(20_000))
    got = keyed(line_dedup.digests(corpus.frame(spark, ["\n".join(["the same"] * 20_000), many, many, "y " * 1_000_000])))
    assert [got[k]["n_removed"] for k in range(4)] == [19_999, 0, 20_000, 0]


def test_lines_edges(spark):
    assert line_dedup.digests(corpus.empty(spark)).count() == 0
    got = line_dedup.digests(corpus.frame(spark, ["a\nb\nc\nd", "a\nb\nc\nd", None, "x"], [1, 1, 2, None])).collect()
    assert len(got) == 4 and {r["n_lines"] for r in got if r["doc_id"] == 2} == {0}


def test_lines_are_native(spark):
    plan = line_dedup.digests(corpus.frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_jaccard(items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in items.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    return {d: (len(sets[d]), root[d]) for d in sets}


def near_copies(seed, count):
    """A text and copies with a few words changed, some of them alike only with each other."""
    r = random.Random(seed)
    base = [corpus.word(r) + str(k % 7) for k in range(120)]
    out = [" ".join(base)]
    for k in range(count):
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = corpus.word(r)
        out.append(" ".join(w[: len(w) - k % 5 * 3]).upper() if k % 11 == 0 else " ".join(w[: len(w) - k % 5 * 3]))
    return out


@pytest.mark.parametrize(("block", "frequent"), [(1024, 16), (4, 2), (1, 1 << 40)])
def test_jaccard(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(J, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(J, "LEAST_FREQUENT", frequent)
    items = corpus.texts(11, 30) + near_copies(1, 40) + near_copies(2, 12)
    ids = random.Random(3).sample(range(-50, 5000), len(items))
    got = {k: (v["n_shingles"], v["component_id"]) for k, v in keyed(J.join(corpus.frame(spark, items, ids))).items()}
    want = brute_jaccard(dict(zip(ids, items, strict=True)))
    assert got == want and len({c for _, c in want.values()}) < len(ids) - 30


def test_overlaps_are_derived():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.choice(1 << 40, 300, replace=False)
    sets = [np.unique(np.concatenate([np.delete(base, r.choice(300, k % 40)), r.choice(1 << 40, k % 25)])).astype(np.uint64) for k in range(60)]
    sets += [np.unique(r.choice(1 << 40, 50)).astype(np.uint64), sets[3][:1], sets[5]]
    got = dict(J.overlaps(sets))
    assert all(got[i][j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)))


def test_jaccard_in_small_parts(spark, monkeypatch):
    """Clusters cut by bytes and lists cut into parts lose no link."""
    for name, n in (("CLUSTER_BYTES", 2000), ("LIST_BLOCK", 3), ("BLOCK", 2), ("LEAST_FREQUENT", 1 << 40)):
        monkeypatch.setattr(J, name, n)
    items = dict(enumerate(corpus.texts(13, 30) + near_copies(5, 40) + near_copies(6, 20)))
    got = {k: (v["n_shingles"], v["component_id"]) for k, v in keyed(J.join(corpus.frame(spark, list(items.values())))).items()}
    assert got == brute_jaccard(items)
    monkeypatch.setattr(J, "_clusters", lambda lists: lists.selectExpr("doc", "n", "doc as cluster").distinct())
    got = {k: (v["n_shingles"], v["component_id"]) for k, v in keyed(J.join(corpus.frame(spark, list(items.values())))).items()}
    assert got == brute_jaccard(items)


def test_jaccard_without_clusters(spark, monkeypatch):
    """All links have to come from the index lists alone where no cluster forms."""
    monkeypatch.setattr(J, "_clusters", lambda lists: lists.selectExpr("doc", "n", "doc as cluster").distinct())
    items = dict(enumerate(corpus.texts(12, 30) + near_copies(4, 30)))
    got = {k: (v["n_shingles"], v["component_id"]) for k, v in keyed(J.join(corpus.frame(spark, list(items.values())))).items()}
    assert got == brute_jaccard(items)


def test_jaccard_edges(spark):
    assert J.join(corpus.empty(spark)).count() == 0
    got = J.join(corpus.frame(spark, ["a b c d e f", "a b c d e f", None, "z"], [1, 1, 2, None])).collect()
    assert len(got) == 4 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (None, None)}
