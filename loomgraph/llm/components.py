"""Connected components by alternating large-star and small-star rounds, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the least b of each a. The least comes from a partial aggregate; a hot a is split by the skew join."""
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("least")), "a")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of longs to (node, root): root is the least node reachable. Nodes that are roots have no row.

    Self-loops, repeated edges and an empty table are allowed. Every round is written to the shared folder, so a lost
    executor costs at most one round; the number of rounds grows with the logarithm of a component's size.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        small = _star(large)
        small = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            large.groupBy("a").agg(F.min("b").alias("b"))
        )
        after = scratch.keep(small.distinct())
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
