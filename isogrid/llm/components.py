"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of these. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node of ``edges`` (columns u, v; u != v) but the least of its component, with that least one.

    Repeated edges count once; an empty table gives an empty one. The node of a huge star is never gathered: minima are
    pre-aggregated and joins on it can be split. Each round is a table in the shared checkpoint folder, deleted when the
    next one is there; rounds end when nothing changes.
    """
    spark = edges.sparkSession
    now, path = stored_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        following, new_path = stored_at(_small_star(_large_star(now)), "edges")
        forget(spark, path)
        before, now, path = mark, following, new_path
