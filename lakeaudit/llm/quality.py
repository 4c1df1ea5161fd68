"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Tokens are runs of letters, digits or signs, hashed into a fixed number of
buckets. Each bucket has a sparse random index vector; a bucket's word vector is
the sum of the index vectors of the tokens near its occurrences, over all
documents. A document is the mean of its tokens' word vectors (unit length,
common mean removed) and the mean of their squares. A two-layer network in
numpy maps that to a probability, with a temperature fitted on rows that
training does not see. The network is fitted on at most SAMPLE labelled rows.

Context sums leave a task as one table of fixed size and are added in two
levels, so no task holds more than about the root of the number of tasks.

Defined results: null text counts as empty; an empty text scores as the zero
vector; without labelled rows of both kinds every score is the share of good
rows (0.5 without rows); an empty table gives an empty table. Repeated rows are
scored one by one. ``classify`` returns the key and the score; other columns of
the input don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import materialise

BUCKET_BITS, DIM, NONZERO, WINDOW = 13, 32, 4, 2
BUCKETS, BLOCK = 1 << BUCKET_BITS, 256
#: Bound of the training sample, in labelled rows.
SAMPLE = 20_000
_rng = np.random.default_rng(97)
_PLACE = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
_CLASS = np.full(256, 3, np.uint8)
_CLASS[tk.SPACE] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token buckets of runs of texts, and where each text begins."""
    data, off = tk.utf8(texts)
    for lo, hi in tk.slices(off):
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        cls = _CLASS[part]
        starts, ends = tk.runs(part, o, cls > 0, cls)
        yield (tk.run_hashes(part, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(starts, o)


def _contexts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for b, at in tokens(batch.column(0)):
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for gap in range(1, WINDOW + 1):
                    near = np.flatnonzero(doc[gap:] == doc[:-gap])
                    x, y = b[near], b[near + gap]
                    for word, other in ((x, y), (y, x)):
                        for k in range(NONZERO):
                            total += np.bincount(word * DIM + _PLACE[other, k], _SIGN[other, k], BUCKETS * DIM)
        task = TaskContext.get().partitionId()
        rows = total.reshape(-1, BLOCK * DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), task % parts)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "salt", "sums"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK * DIM)
    for x in pdf["sums"]:
        total += np.frombuffer(x)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit vectors from the contexts of all documents."""
    tasks = docs.rdd.getNumPartitions()
    sums = docs.select(text).mapInArrow(_contexts(max(1, math.isqrt(tasks))), "block long, salt long, sums binary")
    for keys in (["block", "salt"], ["block"]):
        sums = sums.groupBy(*keys).applyInPandas(_add, "block long, salt long, sums binary")
    got = {r["block"]: np.frombuffer(r["sums"]) for r in sums.collect()}  # a table of fixed size
    v = np.concatenate([got.get(i, np.zeros(BLOCK * DIM)) for i in range(BUCKETS // BLOCK)]).reshape(BUCKETS, DIM)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    used = np.abs(v).sum(axis=1) > 0
    return v - v[used].mean(axis=0) * used[:, None] if used.any() else v


def pool(docs: DataFrame, vectors: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector): mean and mean square of the word vectors of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(shared.value.T)
        squares = columns**2
        for batch in batches:
            out = []
            for b, at in tokens(batch.column(1)):
                n = np.diff(at)
                full = n > 0
                x = np.zeros((len(n), 2 * DIM), np.float32)
                if full.any():
                    for c in range(DIM):
                        x[full, c] = np.add.reduceat(columns[c].take(b), at[:-1][full])
                        x[full, DIM + c] = np.add.reduceat(squares[c].take(b), at[:-1][full])
                    x[full] /= n[full, None]
                out += [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, vector binary")


class Network:
    """Two layers; probabilities of label 1."""

    def __init__(self, share: float, width: int = 2 * DIM, hidden: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.share, self.fitted, self.t = np.zeros(width), np.ones(width), share, False, 1.0
        self.p = [r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p[0] + self.p[1], 0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.t, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3) -> Network:
        if len(set(y.tolist())) < 2:
            return self
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held].tolist())) < 2:
            held[:] = False
        tx, ty = x[~held].astype(np.float64), y[~held]
        self.mean, self.scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        r = np.random.default_rng(11)
        z = np.clip((tx - self.mean) / self.scale, -6, 6)
        for _ in range(epochs):
            order = r.permutation(len(ty))
            for at in range(0, len(order), 128):
                i = order[at : at + 128]
                h = np.maximum(z[i] @ self.p[0] + self.p[1], 0)
                d = 1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -40, 40))) - ty[i]
                back = (d[:, None] * self.p[2]) * (h > 0)
                grads = [z[i].T @ back / len(i) + 1e-4 * self.p[0], back.mean(axis=0), h.T @ d / len(i) + 1e-4 * self.p[2], np.array([d.mean()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.fitted = True
        if held.any():
            s, ly = self.logit(x[held]), np.where(y[held] == 1, 1, -1)
            self.t = float(min(np.geomspace(0.2, 20, 80), key=lambda t: np.logaddexp(0, -ly * s / t).mean()))
        return self


def classify(docs: DataFrame, labels: DataFrame, usable: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score): learns from the labelled rows whose doc_id is usable; scores every document."""
    spark = docs.sparkSession
    pooled = materialise(pool(docs, word_vectors(docs, text=text), key=key, text=text), "pooled")
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(usable).distinct()
    n = known.count()
    chosen = known.withColumn("u", F.xxhash64("doc_id", "y").cast("double") / 2.0**64 + 0.5).where(F.col("u") < SAMPLE / max(n, 1))
    sample = chosen.join(pooled, F.col("doc_id") == F.col("id")).select("u", "y", "vector", "doc_id").toArrow().sort_by([("u", "ascending"), ("doc_id", "ascending"), ("vector", "ascending")])
    y = sample["y"].to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(sample["vector"].to_pylist()), np.float32).reshape(-1, 2 * DIM)
    net = Network(float(y.mean()) if len(y) else 0.5).fit(x, y)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 2 * DIM)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(v).astype(np.float64))], names=["doc_id", "score"])

    return pooled.mapInArrow(run, "doc_id long, score double")
