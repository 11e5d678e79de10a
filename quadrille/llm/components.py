"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is a grouped minimum (pre-aggregated before its shuffle) and an equi-join, whose hot keys
(hubs) Spark splits at run time, as both sides are tables: it can't where one comes straight from an aggregate. Rounds end with a table in the shared folder. The number of rounds grows
with the logarithm of the longest chain; nothing is collected but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) touches; the root is the component's smallest node, itself included.

    Nodes are of any ordered type, without nulls. Repeated links, links both ways and links of a node to itself do no harm.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while not _is_stars(edges):
        edges = materialize(_small_star(_large_star(edges)), "edges")
    tips = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tips.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
