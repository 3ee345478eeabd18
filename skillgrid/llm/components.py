"""Connected components by alternating large-star and small-star steps, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import kept


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").unionByName(back)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
    tied = near.where("v > u").join(least, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lows = down.join(least.withColumnRenamed("u", "lu"), F.col("u") == F.col("lu")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lows.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node that can be reached.

    ``edges`` has u and v of one ordered type. Loops and repeated edges don't matter, edges with a
    null end are no edges, no edges give no rows. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the graph. Only the edge count and a checksum
    reach the driver. Hubs cost one row per edge: their minimum is pre-aggregated.
    """
    edges = kept(edges.select("u", "v").where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = kept(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
