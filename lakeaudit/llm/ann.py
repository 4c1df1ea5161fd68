"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k-means codebook
(fitted on at most SAMPLE rows; their size grows with the square root of the
table, up to what the sample supports); a cell is a pair of codes and every row is
indexed. A query walks the pairs of centroids in order of summed distance with a
heap (the multi-sequence walk). For inner products the distance of a centroid is
how far its product with the query's half falls below the best one. The walk
stops where even a cell's score plus Z standard deviations of what quantisation
leaves out stays below the query's k-th best score within the sample, a lower
bound of the final one; so the number of cells follows from the data, not from a
cap. Entries of the visited cells are reranked: a matrix product finds those near
or above the k-th best, whose products are then summed again, each pair in the
same order, so equal vectors have equal scores wherever they lie.

Cells are cut into blocks of about BLOCK rows (a cell of copies into several),
the queries that visit a block into groups of QUERIES; a task multiplies one
block by one group, so memory is bounded and only each block's best k leave it.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; of the vectors of a repeated id
the smallest counts; ties go to the smaller vec_id;
with fewer candidates all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

SAMPLE, ROUNDS, Z = 8192, 12, 3.3
#: Codes of a half: least and most (a sample holds 32 rows for each), and rows a cell of the codebooks between.
LEAST, MOST, ROWS = 16, 256, 16
#: Part of a score that summing in another order may change.
SLIP = 1e-9
BLOCK, QUERIES = 4096, 2048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, with double components."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def codes(n: int) -> int:
    """Codes of a half for n rows."""
    return min(MOST, max(LEAST, math.isqrt(n // ROWS)))


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    r = np.random.default_rng(3)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        a = nearest(x, c)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, ids: np.ndarray, k: int, codes: int):
        self.codes = codes
        self.half = max(1, sample.shape[1] // 2)
        self.k, self.sample, self.ids = k, sample, ids
        halves = [sample[:, : self.half], sample[:, self.half :]]
        self.books = [codebook(h, codes) if h.shape[1] else np.zeros((1, 0)) for h in halves]
        self.spread = [np.cov((h - b[nearest(h, b)]).T, bias=True).reshape(h.shape[1], h.shape[1]) if h.shape[1] and len(h) > 1 else np.zeros((h.shape[1],) * 2) for h, b in zip(halves, self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.codes + (nearest(x[:, self.half :], self.books[1]) if x.shape[1] > self.half else 0)

    def walk(self, q: np.ndarray, own: int, full: np.ndarray) -> list[int]:
        """Non-empty cells by falling score, until none can hold one of the k best any more."""
        a, b = q[: self.half], q[self.half :]
        s, t = self.books[0] @ a, self.books[1] @ b
        i, j = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
        known = (self.sample @ q)[self.ids != own]
        least = np.partition(known, -self.k)[-self.k] if len(known) >= self.k else -np.inf
        slack = Z * float(np.sqrt(max(0.0, a @ self.spread[0] @ a + b @ self.spread[1] @ b)))
        best = s[i[0]] + t[j[0]]
        heap, seen, out = [(0.0, 0, 0)], {(0, 0)}, []
        while heap:
            far, x, y = heapq.heappop(heap)
            if best - far + slack < least:
                break
            cell = int(i[x]) * self.codes + int(j[y])
            if full[cell]:
                out.append(cell)
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < len(i) and v < len(j) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (best - s[i[u]] - t[j[v]], u, v))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query but itself."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(vectors, key, vector), "vectors")
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], result)
    sampled = rows.where(F.xxhash64("id").cast("double") / 2.0**64 + 0.5 < SAMPLE / n).toArrow().sort_by("id")
    if not len(sampled):
        sampled = rows.limit(SAMPLE).toArrow().sort_by("id")
    index = spark.sparkContext.broadcast(MultiIndex(_matrix(sampled["v"].combine_chunks()), sampled["id"].to_numpy(), k, codes(n)))
    n_cells = codes(n) ** 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.value.cells(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "cell", "v"])

    cells = materialise(rows.mapInArrow(assign, "id long, cell long, v binary"), "cells")
    counts = np.zeros(n_cells, np.int64)
    for r in cells.groupBy("cell").count().collect():  # at most MOST * MOST rows
        counts[r["cell"]] = r["count"]
    # neighbouring small cells share a block, a large cell has several
    parts = np.maximum(1, -(-counts // BLOCK))
    first, load, block = np.zeros(len(counts), np.int64), 0, 0
    for c in np.flatnonzero(counts):
        if parts[c] > 1 or load + counts[c] > BLOCK:
            block, load = block + 1, 0
        first[c] = block
        load += counts[c]
        if parts[c] > 1:
            block, load = block + int(parts[c]), 0
    place = spark.sparkContext.broadcast((first, parts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, p = place.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                out = []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by: dict[int, list[int]] = {}
                    for c in index.value.walk(np.array(v), i, counts > 0):
                        for s in range(int(p[c])):
                            by.setdefault(int(f[c]) + s, []).append(c)
                    raw = np.array(v).tobytes()
                    out += [(x, i, raw, np.array(cs, np.int32).tobytes()) for x, cs in by.items()]
                x, i, v, c = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.binary()), pa.array(c, pa.binary())], names=["block", "query", "v", "cells"])

    asked = queries.select(F.col(key).cast("long").alias("id")).distinct()
    # a query walks hundreds of centroid pairs in Python: spread them
    visits = rows.join(asked, "id", "left_semi").repartition(shuffle_width(spark), F.xxhash64("id")).mapInArrow(visit, "block long, query long, v binary, cells binary")
    visits = materialise(visits, "visits")
    groups = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups"))
    left = visits.join(groups, "block").select("block", F.pmod(F.xxhash64("query"), "groups").alias("g"), "query", "v", "cells")
    first_of = spark.createDataFrame(pd.DataFrame({"cell": np.flatnonzero(counts), "first": first[counts > 0], "parts": parts[counts > 0]}))
    right = cells.join(F.broadcast(first_of), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
    right = right.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), "id", "cell", "v")

    def rerank(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        xs = xs.sort_values("id")
        x, ids, cell = np.frombuffer(b"".join(xs["v"])).reshape(len(xs), -1), xs["id"].to_numpy(), xs["cell"].to_numpy()
        largest = np.abs(x).max(axis=0)
        of, found = np.zeros(n_cells, bool), []
        for lo in range(0, len(qs), 256):
            part = qs.iloc[lo : lo + 256]
            asked = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
            score, reach = asked @ x.T, np.abs(asked) @ largest
            for row, (q, cs) in enumerate(zip(part["query"], part["cells"], strict=True)):
                of[:] = False
                of[np.frombuffer(cs, np.int32)] = True
                at = np.flatnonzero(of[cell] & (ids != q))
                s = score[row, at]
                if len(at) > k:
                    at = at[s >= np.partition(s, -k)[-k] - SLIP * reach[row]]
                s = (x[at] * asked[row]).sum(axis=1)
                top = np.lexsort((ids[at], -s))[:k]
                found.append((np.full(len(top), q), ids[at[top]], s[top]))
        q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    best = left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
