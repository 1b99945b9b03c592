"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected links between ids -> (id, component), component the smallest id reachable.

    Ids in no link don't appear; links of an id with itself, repeated links and null ids change nothing. An empty
    table gives an empty table. Each round groups by node and keeps one minimum a node, so no group is gathered; the
    number of rounds grows with the logarithm of the longest chain. Every round is cut by a checkpoint.
    """
    edges = durable(edges.select("a", "b").where("a is not null and b is not null and a != b").distinct())
    seen = None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == seen or not size[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = size
        edges = durable(_small_star(_large_star(edges)))
