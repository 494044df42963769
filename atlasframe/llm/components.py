"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges (a, b; of one type) with the smallest node it can reach.

    Alternating star steps: each node hands its larger neighbours, then its smaller ones, to the smallest of them.
    Both are a grouped minimum and a join, never a list of neighbours; the number of rounds grows with the
    logarithm of the longest path. The driver sees one row of counts a round. Loops count as nodes; nulls aren't allowed.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(step.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == seen:
            break
        stamp = seen
    root = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
