"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is joins and aggregates over edges; a node's smallest neighbour is found by a
map-side combined ``min``, so a hub costs its edges once. Each round is cut from its lineage by a
checkpoint in the shared folder. The number of rounds grows with the logarithm of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmatch.llm.common import shared


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours move to the least of the neighbourhood. Small star: smaller ones do."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a"))
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        out = edges.join(least, "b").select(F.explode(F.array(F.struct(F.col("a").alias("b"), F.col("m").alias("a")), F.struct(F.col("b").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.*")
    return out.where("a < b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) with a < b, distinct. Returns (node, root) for every node with an edge; root is the least node of its component."""
    before = None
    while True:
        edges = shared(stars(stars(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
