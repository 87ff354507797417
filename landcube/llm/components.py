"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Each row's (a, b) with m, the smallest b of its a. The minima are written, so a hub's rows can be split in the join."""
    smallest = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
    return edges.join(smallest, "a")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _star(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    large = materialize(large.where("a <> b").distinct(), "large")
    small = _star(large)
    down = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
    return materialize(down.where("a <> b").distinct(), "small")


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node in ``pairs`` (a, b); root is the component's smallest node. Nulls take no part.

    After each round every edge leads from a larger to a smaller node; once nothing changes, all lead to their root. The
    number of rounds grows with the logarithm of the graph's size. Only a count and a checksum come to the driver.
    """
    edges = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state, edges = found, _round(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
