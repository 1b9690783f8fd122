"""Small corpora with copies, near copies, shared lines, nulls, empty and long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, gone string, ids string, score string"
WORDS = ["ta", "re", "mi", "on", "the", "ing", "ça", "é", "ou", "st", "ner", "lo"]


def word(r):
    return "".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))


def line(r, n=None):
    return " ".join(word(r) for _ in range(n or r.randint(3, 14))) + "."


def texts(seed=5, docs=40):
    r = random.Random(seed)
    shared = [line(r, 25) for _ in range(3)]
    out = ["\n".join(line(r) for _ in range(r.randint(1, 9))) for _ in range(docs)]
    for k in range(docs // 2):
        base = r.choice(out[:docs]).split("\n")
        kind = k % 5
        if kind == 0:
            out.append("\n".join(base))
        elif kind == 1:
            words = "\n".join(base).split(" ")
            words[r.randrange(len(words))] = word(r)
            out.append(" ".join(words))
        elif kind == 2:
            out.append("\n".join([line(r), *base, line(r)]))
        elif kind == 3:
            out.append(f"{line(r)}\n{r.choice(shared)}\n{line(r)}")
        else:
            out.append(f"{line(r)} {r.choice(shared)} {line(r)}")
    out += [None, "", " ", "\n\n\n", "a", "a b c d", "A b C d", "x" * 500, "ab" * 300, " ".join(["again"] * 200), "\n".join(["one more line of it"] * 9), "\n".join(line(r) for _ in range(400))]
    return out


def frame(spark, items, ids=None):
    rows = [(k if ids is None else ids[k], x, "en", "s", None if x is None else len(x), "old", "old", "old", "old") for k, x in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
