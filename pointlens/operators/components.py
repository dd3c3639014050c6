"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.sources.shared import checkpoint, remove, stored


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v: long, any direction, loops and repeats allowed).

    Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to
    the least node it knows. A hub only costs one minimum, which is summed up before the shuffle. Every round is
    cut off by a checkpoint; it ends when all links are stars around least nodes.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
        if ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 OR low + top > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least nodes are written as a table, so that Spark can split the hub of a join, whose two sides are then plain scans, and knows its size
        least, at = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        large = checkpoint(both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        remove(edges.sparkSession, at)
        lowest, at = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"))
        moved = large.join(lowest, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(moved.unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        remove(edges.sparkSession, at)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
