"""Language identification with a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Bytes of a window; texts are cut into consecutive windows, the last one padded with zero bytes.
WINDOW = 256
#: Filter widths, and filters of each width.
WIDTHS, FILTERS = (2, 3, 4, 5), 8
#: Bounds of the training sample: documents for each language, windows of each document, languages that get so many documents.
DOCS_PER_LANG, WINDOWS_PER_DOC, MAX_LANGS = 400, 3, 64
#: With more languages each gets fewer documents, but no fewer than this.
LEAST_DOCS = 16
UNKNOWN = "und"


@dataclass
class Model:
    """Labels, one table of 256 rows for each filter offset (all widths side by side), biases and the output layer."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: bytes) -> np.ndarray:
    """All of `data` as rows of WINDOW bytes."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return flat.reshape(n, WINDOW)


def _starts(offset: int) -> int:
    """The first column that filters of more than `offset` bytes have."""
    return FILTERS * sum(w <= offset for w in WIDTHS)


def convolve(x: np.ndarray, m: Model) -> np.ndarray:
    """Filter responses (windows, positions, filters). A convolution over one-hot bytes is a sum of table rows."""
    rows, reach = len(x), WINDOW + max(WIDTHS) - 1
    wide = np.zeros((rows, reach), np.uint8)
    wide[:, :WINDOW] = x
    out = m.tables[0][wide[:, :WINDOW]]
    for j in range(1, max(WIDTHS)):
        out[:, :, _starts(j) :] += m.tables[j][wide[:, j : j + WINDOW]]
    return out


def probabilities(x: np.ndarray, m: Model) -> np.ndarray:
    """Softmax over the labels for each window."""
    pooled = np.maximum(convolve(x, m).max(1) + m.bias, 0)
    z = pooled @ m.out + m.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, m: Model) -> list[np.ndarray]:
    """The gradients of the mean cross entropy by tables, bias, output layer and its bias. Only the position that wins the max
    pooling passes one on to its bytes' rows."""
    total = FILTERS * len(WIDTHS)
    conv = convolve(x, m)
    best = conv.argmax(1)
    raw = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + m.bias
    act = np.maximum(raw, 0)
    z = act @ m.out + m.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    d = z / z.sum(1, keepdims=True)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    back = (d @ m.out.T) * (raw > 0)
    grads = []
    wide = np.zeros((len(x), WINDOW + max(WIDTHS) - 1), np.uint8)
    wide[:, :WINDOW] = x
    rows = np.arange(len(x))[:, None]
    for j, t in enumerate(m.tables):
        s = _starts(j)
        g = np.zeros_like(t)
        np.add.at(g, (wide[rows, best[:, s:] + j], np.arange(total - s)[None, :]), back[:, s:])
        grads.append(g)
    return [*grads, back.sum(0), act.T @ d, d.sum(0)]


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (256, total - _starts(j))).astype(np.float32) for j in range(max(WIDTHS))]
    m = Model(labels, tables, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    params = [*m.tables, m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            step += 1
            for p, g, a, b in zip(params, gradients(x[order[k : k + 64]], y[order[k : k + 64]], m), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def fit(labelled: DataFrame) -> Model | None:
    """Train on a bounded sample of `labelled` (doc_id, text, lang): about DOCS_PER_LANG documents of each
    language, up to WINDOWS_PER_DOC evenly spaced windows of each. With more than MAX_LANGS languages each gets fewer documents,
    so that the sample stays bounded; so many that fewer than LEAST_DOCS are left for each are refused, none is dropped.

    Rows with null text or language don't count; without any there is no model. The sample goes by a hash of doc_id and text,
    so it is the same on every run; the languages are counted over all rows. Equal rows, however many, are one row of the sample.
    """
    seen = labelled.where("text is not null and lang is not null and doc_id is not null")
    # by id and text, so that rows of one id are drawn apart; a language's least draw is always in, so none is without a sample
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30))
    counts = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(lot).alias("least")).orderBy(F.desc("count"), "lang").limit(DOCS_PER_LANG * MAX_LANGS // LEAST_DOCS + 1).collect()
    if not counts:
        return None
    each = DOCS_PER_LANG * min(1.0, MAX_LANGS / len(counts))
    if each < LEAST_DOCS:
        raise ValueError(f"more than {len(counts) - 1} languages leave fewer than {LEAST_DOCS} documents for each")
    upto = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], max(r["least"], int(min(1.0, each / r["count"]) * (1 << 30))))])
    chosen = seen.where(lot <= F.try_element_at(upto, "lang"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, lang in zip(pdf["key"], pdf["text"], pdf["lang"], strict=True):
                w = windows(text.encode())
                for k in sorted({0, len(w) // 2, len(w) - 1})[:WINDOWS_PER_DOC]:
                    rows.append((key, w[k].tobytes(), lang))
            yield pd.DataFrame(rows, columns=["key", "w", "lang"])

    cuts = chosen.select(F.xxhash64("doc_id", "text", F.lit("order")).alias("key"), "text", "lang").mapInPandas(cut, "key long, w binary, lang string")
    # the share gives the expected size; equal rows count once, and the limit holds where they differ a little
    got = cuts.distinct().orderBy("key", "w", "lang").limit(int(2 * WINDOWS_PER_DOC * each * len(counts))).collect()
    labels = sorted({r["lang"] for r in got})
    got.sort(key=lambda r: (bytes(r["w"]), r["lang"]))
    x = np.frombuffer(b"".join(bytes(r["w"]) for r in got), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([labels.index(r["lang"]) for r in got]), labels)


def _votes(data: list[bytes], parts: list[np.ndarray], m: Model) -> tuple[list[str], list[float]]:
    """Label and score of each text from the probabilities of its windows, weighted by the bytes they hold."""
    sums = np.zeros((len(data), len(m.labels)))
    own = np.repeat(np.arange(len(data)), [len(p) for p in parts])
    x = np.concatenate(parts)
    size = np.array([len(d) for d in data])
    used = np.minimum(WINDOW, size[own] - WINDOW * (np.arange(len(own)) - np.searchsorted(own, own)))
    for s in range(0, len(x), 128):
        np.add.at(sums, own[s : s + 128], probabilities(x[s : s + 128], m) * used[s : s + 128, None])
    best = sums.argmax(1)
    score = np.clip(sums[np.arange(len(data)), best] / np.maximum(sums.sum(1), 1e-9), 0, 1)
    return [m.labels[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)], np.where(size > 0, score, 0.0).tolist()


def identify(docs: DataFrame, model: Model | None, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language of each whole text and its score, the mean probability over the text's windows,
    weighted by their bytes.

    A text that is null or has no letter, and any text where there is no model, is `und` with score 0. All windows of a
    text count, in blocks, so a long text costs time and no memory. Columns named like the new ones are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    if model is None:
        return docs.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        for texts, lettered in batches:
            told, sure, k = [], [], 0
            texts = texts.cast(pa.binary())
            while k < len(texts):
                data, parts = [], []
                while k < len(texts) and sum(map(len, parts)) < 512:
                    data.append(texts[k].as_py() if lettered[k].as_py() else b"")
                    parts.append(windows(data[-1]) if data[-1] else np.empty((0, WINDOW), np.uint8))
                    k += 1
                p, s = _votes(data, parts, m)
                told += p
                sure += s
            yield pa.StructArray.from_arrays([pa.array(told, pa.string()), pa.array(sure, pa.float64())], names=["p", "s"])

    guess = F.arrow_udf(scores, "p string, s double")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    name = fresh(docs, "guess")
    return docs.withColumn(name, guess(F.col("text"), lettered)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(f"{name}.p").alias(pred_col), F.col(f"{name}.s").alias(score_col)
    )


def held_out(col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns only from documents that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
