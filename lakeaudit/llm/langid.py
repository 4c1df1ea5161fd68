"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte 2- to 4-grams (letters in
lower case, everything else a blank), hashed into a fixed number of buckets; a
linear softmax sits on top. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A
temperature and a rejection threshold are calibrated on a part of the sample
that training does not see.

Because mean and softmax weights are both linear, prediction folds them into
one table of bucket logits, so a text costs a gather and a segmented sum.

Defined results: a text that is null, empty or has no letter is ``und`` with
score 0; equal texts get equal results; an empty training set makes every text
``und``; with one learned language that language has score 1. Extra columns of
the input pass through, but for those named like a result column.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk

#: Bound of the training sample, in texts of one language.
SAMPLE_PER_LANGUAGE = 400
#: Bound of the training sample, in bytes of text of one language.
SAMPLE_BYTES = 1_200_000
#: Texts of more bytes enter the sample after all others, so that they don't fill it.
LONG_BYTES = 60_000
#: Least number of steps of the gradient descent.
STEPS = 400
BUCKET_BITS = 14
ORDERS = (2, 3, 4)
DIM = 8
UNKNOWN = "und"

#: ASCII letters in lower case and the bytes of other characters stay; all else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_TABLE = 1 << BUCKET_BITS


def gram_buckets(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the bucket of the gram at each byte, and whether it ends within its text."""
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    end = np.repeat(off[1:], np.diff(off))
    key = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if n < order:
            return
        key = key[: n - order + 1] * np.uint32(0x01000193) + folded[order - 1 :] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            h = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield order, ((h >> np.uint32(32 - BUCKET_BITS)) + np.uint32(_TABLE * (order - 1))).astype(np.int64), np.arange(n - order + 1) + order <= end[: n - order + 1]


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    found = np.zeros(len(off) - 1, bool)
    for lo, hi in tk.slices(off):
        seen = np.r_[0, np.cumsum(_LETTER[data[off[lo] : off[hi]]], dtype=np.int32)]
        at = off[lo : hi + 1] - off[lo]
        found[lo:hi] = seen[at[1:]] > seen[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(unicodedata.category(c)[0] == "L" for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, k = len(off) - 1, len(self.languages)
        columns = [np.ascontiguousarray(self.logits[:, c]) for c in range(k)]
        out = np.zeros((n, k))
        if k == 0:
            return out
        for lo, hi in tk.slices(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            full = np.flatnonzero(np.diff(o) > 0)
            total, grams = np.zeros((hi - lo, k)), np.zeros(hi - lo)
            for order, bucket, whole in gram_buckets(part, o):
                bucket = np.where(whole, bucket, len(self.logits) - 1)  # the last row is zero
                at = o[:-1][full]
                inside = at < len(bucket)
                rows, at = full[inside], at[inside]
                for c in range(k):
                    total[rows, c] += np.add.reduceat(columns[c].take(bucket), at)
                grams[rows] += np.maximum(np.diff(o)[rows] - order + 1, 0)
            z = (total / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            out[lo:hi] = e / e.sum(axis=1, keepdims=True)
        return out


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    out = []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        off = np.array([0, len(data)])
        b = np.concatenate([x[w] for _, x, w in gram_buckets(data, off)] or [np.zeros(0, np.int64)])
        u, c = np.unique(b, return_counts=True)
        out.append((u, c / max(1, c.sum())))
    return out


def train(texts: list[str], labels: list[str], *, epochs: int = 4, least: int = STEPS, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Fit on the sample, in so many epochs and at least so many steps, so that small samples are learned as well; every fifth text is left for calibration."""
    languages = tuple(sorted(set(labels)))
    k, rows = len(languages), max(ORDERS) * _TABLE + 1
    if k == 0:
        return LanguageModel((), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y_all = np.searchsorted(languages, labels)
    x_all = _sparse(texts)
    held = np.arange(len(texts)) % 5 == 4
    if held.all() or not held.any() or len(set(y_all[~held])) < k:
        held[:] = False
    embed = rng.normal(0, 0.1, (rows, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    own = np.flatnonzero(~held)
    batch, steps = 32, 0
    each = max(1, -(-len(own) // batch))
    epochs = max(epochs, -(-least // each))
    total = epochs * each
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            ids = own[at : at + batch]
            pairs = [x_all[i] for i in ids]
            b, w = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            doc = np.repeat(np.arange(len(ids)), [len(p[0]) for p in pairs])
            mean = np.zeros((len(ids), DIM))
            np.add.at(mean, doc, embed[b] * w[:, None])
            z = mean @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ids)), y_all[ids]] -= 1
            p /= len(ids)
            step = rate * (1 - steps / total)
            back = p @ weight.T
            weight -= step * (mean.T @ p)
            bias -= step * p.sum(axis=0)
            np.add.at(embed, b, -step * 20 * back[doc] * w[:, None])  # each bucket holds a small share of its text
            steps += 1
    logits = np.vstack([embed[:-1] @ weight, np.zeros((1, k))])
    model = LanguageModel(languages, logits.astype(np.float32), bias, 1.0, 0.0)
    return calibrate(model, [texts[i] for i in np.flatnonzero(held)], y_all[held])


def calibrate(model: LanguageModel, texts: list[str], y: np.ndarray) -> LanguageModel:
    """Temperature by likelihood; the threshold leaves out at most one right prediction in a thousand."""
    if not texts:
        return model
    joined = pa.array(texts, pa.large_string())
    data, off = tk.utf8(joined)
    z = np.log(np.maximum(model.probabilities(data, off), 1e-300))

    def likelihood(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    t = max(np.geomspace(0.2, 10, 60), key=likelihood)
    s = np.exp((z - z.max(axis=1, keepdims=True)) / t)
    top = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
    right = np.sort(top[z.argmax(axis=1) == y])
    floor = 1.5 / max(2, len(model.languages))
    reject = min(floor, float(right[int(len(right) * 0.001)]) * 0.9) if len(right) else 0.0
    return LanguageModel(model.languages, model.logits, model.bias, float(t), reject)


def fit(docs: DataFrame, usable: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Train on a sample of the usable labelled rows.

    The sample is the rows with small hashes of their keys, about
    SAMPLE_PER_LANGUAGE of each language within SAMPLE_BYTES, and one at least;
    only that bounded sample comes to the driver.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    u = (F.xxhash64(F.col(key).cast("string")).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    keep = F.lit(False)
    for name, n in sorted(counts.items()):
        keep = keep | ((F.col(lang) == F.lit(name)) & (u < F.lit(SAMPLE_PER_LANGUAGE / n)))
    sample = rows.where(keep).select(F.col(lang).alias("l"), F.col(text).alias("t"), u.alias("u"), F.octet_length(text).alias("b"))
    sample = sample.withColumn("no", F.row_number().over(_by_language())).withColumn("b", F.sum("b").over(_by_language().rowsBetween(Window.unboundedPreceding, 0)))
    sample = sample.where((F.col("b") <= SAMPLE_BYTES) | (F.col("no") == 1))
    got = sample.select("l", "t", "u").toArrow().sort_by([("u", "ascending"), ("l", "ascending"), ("t", "ascending")])
    return train(got["t"].to_pylist(), got["l"].to_pylist())


def _by_language():
    return Window.partitionBy("l").orderBy(F.octet_length("t") > LONG_BYTES, "u", "t")


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected. Only the text is read for the prediction."""
    results = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    docs = docs.drop(*results)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in results.items()]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            data, off = tk.utf8(batch.column(text))
            n = batch.num_rows
            lettered = has_letter(data, off) if len(m.languages) else np.zeros(n, bool)
            p = m.probabilities(data, off)
            best = p.argmax(axis=1) if len(m.languages) else np.zeros(n, int)
            score = np.where(lettered, p[np.arange(n), best] if len(m.languages) else 0.0, 0.0)
            label = names[np.where(lettered, best, len(m.languages))]
            out = [pa.array(label, pa.string()), pa.array(score), pa.array(~lettered | (score < m.reject_below))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *results])

    return docs.mapInArrow(run, schema)
