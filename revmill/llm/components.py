"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmill.llm.tables import stored


def _least(edges: DataFrame) -> DataFrame:
    """For each node a, the least of itself and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = both.join(_least(both), "a").where("b > a")
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = _least(edges)
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return tied.unionByName(own).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not the least of its component, with that least node.

    `edges` has two bigint columns a and b in any order; loops do not matter. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now
