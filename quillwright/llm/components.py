"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each round is two aggregates and two joins over the remaining edges, a graph of n nodes needs O(log^2 n) rounds, and the
lineage is cut after each in the shared folder. Nothing is collected but one flag a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b), a > b."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:  # larger neighbours are hung on the least node
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for each node that has a link to another one."""
    edges = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "cc")
    while True:
        after = cut(_star(_star(edges, True), False), "cc")
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        drop(edges)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
