"""Connected components of a graph given by edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import drop, materialize


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long): root is the component's smallest node.

    Each step hooks the neighbours of a node to their smallest one; the minima are aggregated
    before the shuffle and joined in tables of their own, so that a node with very many edges is
    split by the skew join.  The number of steps grows with the logarithm of the longest path.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    n = before[0]  # the steps never add to it
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", n)
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large", n)
        drop(edges, least)
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        joined = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = joined.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialize(edges, "small", n)
        drop(large, least)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
