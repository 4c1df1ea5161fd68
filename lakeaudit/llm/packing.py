"""Conflict-constrained best-fit packing of documents into training sequences.

Lengths are whole words. A document longer than a bin is cut into full bins and
a tail; nothing is dropped. Within a shard, pieces come in order of falling
length; open bins lie in an array by residual capacity, each with a source set
and a duplicate-cluster set (bits of Python integers). The successor search
starts at the smallest residual that fits and goes on through larger ones until
it finds the tightest bin whose sets hold neither the piece's source nor its
cluster; else a bin opens. Counts of the bins that hold a source, by residual,
let the search pass over residuals whose bins all conflict.

Shards are dealt by a hash of the piece and of where its row is stored, so a hot
source and rows that are equal spread evenly; their number follows the number of pieces, and only keys and lengths move.

Defined results: null or blank text has length 0 and its own row with bin -1;
null source or cluster conflicts with nothing; repeated rows are packed each;
an empty table gives an empty table. Extra columns of the input are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .jaccard import components_of

CAPACITY = 2048
#: Pieces of a shard, on average.
SHARD = 8192
SCHEMA = "shard long, bin long, doc_id long, piece long, start long, length long, offset long, source string, cluster string"


def pack_shard(length: np.ndarray, source: list, cluster: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces come in packing order."""
    n = len(length)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ids: dict = {}
    code = lambda kind, x: None if x is None else ids.setdefault((kind, x), len(ids))
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    total = np.zeros(capacity + 1, np.int32)
    holding: dict[int, np.ndarray] = {}
    residual: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    members: list[list[int]] = []
    common = {s for s, c in pd.Series([x for x in source if x is not None], dtype=object).value_counts().items() if c > 16}

    for i in range(n):
        need, s, c = int(length[i]), code("s", source[i]), code("c", cluster[i])
        tracked = s is not None and source[i] in common
        if tracked and s not in holding:
            holding[s] = np.zeros(capacity + 1, np.int32)
        free = total[need:] > (holding[s][need:] if tracked else 0)
        found = -1
        for r in np.flatnonzero(free):
            for b in by_residual[need + int(r)]:
                if (s is None or not sources[b] >> s & 1) and (c is None or not clusters[b] >> c & 1):
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            sources.append(0)
            clusters.append(0)
            members.append([])
            by_residual[capacity].append(found)
            total[capacity] += 1
        old = residual[found]
        bins[i], offsets[i] = found, capacity - old
        total[old] -= 1
        by_residual[old].remove(found)
        for x in members[found]:
            holding[x][old] -= 1
        if s is not None:
            sources[found] |= 1 << s
        if c is not None:
            clusters[found] |= 1 << c
        if tracked:
            members[found].append(s)
        residual[found] = new = old - need
        total[new] += 1
        by_residual[new].append(found)
        for x in members[found]:
            holding[x][new] += 1
    return bins, offsets


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        full = pdf["length"].to_numpy() > 0
        some = pdf[full]
        clean = lambda x: [None if v is None or v != v else v for v in x]
        bins, offsets = pack_shard(some["length"].to_numpy(), clean(some["source"]), clean(some["cluster"]), capacity)
        pdf["bin"], pdf["offset"] = np.int64(-1), np.int64(0)
        pdf.loc[full, "bin"], pdf.loc[full, "offset"] = bins, offsets
        return pdf[[x.split()[0] for x in SCHEMA.split(", ")]]

    return run


def normal_form(text: str) -> Column:
    """The cluster of exact copies: hash of the text in lower case with single blanks."""
    return F.md5(F.trim(F.regexp_replace(F.lower(F.col(text)), "\\s+", " ")))


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, near: tuple[int, int] | None = None
) -> DataFrame:
    """One row for each piece: shard and bin (numbered within it), document, piece, its words start .. start + length, offset in the bin.

    cluster: the cluster of a document; by default that of its exact copies. near: (k, percent), clusters are instead
    the components of near copies by k-word shingles of the text in lower case; exact copies share one too.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), *([] if cluster is None else [cluster.cast("string").alias("cluster")]))
    if near:
        # the join counts the words as it reads the texts
        rows = docs.select(F.coalesce("doc_id", F.xxhash64(F.lower("text"))).alias("node"), F.lower("text").alias("text"), "doc_id", "source")
        rows = components_of(rows, k=near[0], percent=near[1], key="node", carry=("doc_id", "source")).withColumn("cluster", F.col("component").cast("string"))
        rows = materialise(rows.select("doc_id", "words", "source", "cluster"), "lengths")
    else:
        words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != ""))
        rows = docs.withColumn("words", F.when(F.col("text").isNull(), F.lit(0)).otherwise(words).cast("long"))
        rows = rows if cluster is not None else rows.withColumn("cluster", normal_form("text"))
        rows = materialise(rows.select("doc_id", "words", "source", "cluster"), "lengths")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    n = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1))
    shards = max(1, -(-(rows.agg(F.sum(n)).first()[0] or 0) // SHARD))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    rows = rows.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.lit(capacity), F.col("words") - F.col("start"))).drop("words")
    rows = rows.select("doc_id", "source", "cluster", "piece", "start", "length", "row")
    # rows that are equal differ in where they are stored, so they spread too; the table is written, so a task that is run again deals them alike
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "source", "cluster", "row"), F.lit(shards))).drop("row")
    return rows.groupBy("shard").applyInPandas(_pack(capacity), SCHEMA)
