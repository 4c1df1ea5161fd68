"""Connected components of an undirected edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge; loops and repeats are harmless.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a
    grouped minimum and a join, until no edge changes. The minima are written
    before they join, so a hub's edges meet one stored row and the adaptive
    planner can split them. Only sums of the edge table come to the driver.
    """
    now = materialise(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours larger than a node hang from the smallest of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang from the smallest of them
        under = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(under, "v")
        small = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v"))
        old, now = now, materialise(small.where("u <> v").distinct(), "edges")
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = (r[0], r[1])
        discard(old, low)
        if state == before:
            found = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
            found = materialise(found, "components")
            discard(now)
            return found
        before = state
