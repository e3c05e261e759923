"""Connected components of an edge table by alternating large-star and small-star steps, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MOST_STEPS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u; the join's hot keys can be split, as m is one row a key."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) for each node of edges (u, v), both long.

    Each step is written to the checkpoint folder; the number of steps grows with the logarithm of a component's
    size. Nodes without edges are not in the result, nor are null ends.
    """
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct()
    for _ in range(MOST_STEPS):
        now = checkpointed(_small_star(_large_star(now)))
        # settled: stars, in which each node has one edge down and no root has any
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root")).filter("down + root > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
