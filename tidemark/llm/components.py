"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. large: hang larger neighbours under the smallest; small: hang smaller neighbours and the node itself under the smallest.

    The minimum by node is combined before its shuffle and written. The join with it is then a stage of its own,
    which Spark broadcasts or splits where a node has many edges.
    """
    around = edges.union(edges.select("v", "u")) if large else edges
    least = durable(around.groupBy("u").agg(F.min("v").alias("m")), "least")
    if large:
        smallest = F.least("u", "m")
        return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), smallest.alias("v")).distinct()
    hung = around.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges (u, v), u > v, hangs under one other at most, and nothing under those that do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("under").alias("n"), F.min("under").alias("least"))
    return nodes.agg(F.count_if(F.expr("n > 1 or (n = 1 and least = 0)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any direction, repeats and loops allowed -> node, component: the smallest node that it reaches. Nodes without an edge aren't listed.

    Each step is written to the shared folder. The number of steps grows with the logarithm of the largest component.
    Neighbours are never gathered: each step is a minimum by node, combined before the shuffle, and a join. It ends as soon as the
    edges are stars, which edges may be from the start.
    """
    now = durable(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        now = durable(_star(durable(_star(now, large=True), "large"), large=False), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
