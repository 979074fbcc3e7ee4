"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> bool:
    """True if every node has one edge to a root, and no root has an edge to another."""
    many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1)
    return not many and not edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """edges a, b to node, root: the least node of its component, for every node with an edge to another.

    Stars are contracted by turns: each node's larger neighbours are joined to its least one, then its smaller ones. Edges
    are grouped for their least end only, never collected, so a node may have any number of neighbours."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = cut(least, "least")  # a table of its own, so that Spark may split the join at a node of many edges
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "edges")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        edges = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(edges, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
