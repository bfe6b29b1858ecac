"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.durable import written


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, component (the smallest node that it reaches); nodes without an edge to another aren't listed.

    Large and small stars in turn: larger neighbours are hung under the smallest one, then smaller ones. Each step takes a
    minimum by node, combined before its shuffle, and a join; it is written, so that a step is what a lost executor costs.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
        around = now.union(now.select("v", "u"))
        least = written(around.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = written(around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
