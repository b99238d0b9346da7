"""Connected components by alternating large and small stars; edges and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge. edges: a long, b long.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the longest
    path. A node with very many neighbours is reduced to their minimum before the exchange, and joined back
    under the join's skew handling.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(large.filter("a > b").distinct(), "large-star")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialise(small.filter("a > b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
