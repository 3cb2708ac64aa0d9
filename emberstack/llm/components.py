"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.llm.scratch import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of LONG ids to ``(id, component)``, the least id reachable, for every id that has an edge.

    Alternates large-star and small-star steps, each an aggregation by node and a join back, until no edge changes; then
    every edge leads from a node to its component. A node with very many edges is pre-aggregated before it is shuffled, and its
    side of the join is one that Spark can split.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = saved(both)
    before = None
    while True:
        # Large star: every greater neighbour of a node is linked to the node's least neighbour or itself.
        ways = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "node")
        large = ways.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        # Small star: every lesser neighbour of a node, and the node, are linked to the least.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        small = large.join(low, F.col("u") == F.col("node"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("node").alias("u"), F.col("m").alias("v")))
        stars = saved(small.where("u <> v").distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
