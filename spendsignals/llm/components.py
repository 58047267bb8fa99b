"""Connected components of a link table: alternating large-star and small-star steps.

Each step joins links with the least neighbour of a node (a partial aggregate) and writes the result, so
no task holds a component and a node with very many links is a skewed join side that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("_m").alias("a"), "b").where("a < b")


def _small_star(links: DataFrame) -> DataFrame:
    """Links have a < b: each b keeps its least a, its other a's go to that one."""
    least = links.groupBy("b").agg(F.min("a").alias("_m"))
    moved = links.join(least, "b").select(F.col("_m").alias("a"), F.when(F.col("a") == F.col("_m"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return moved.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) for every node of ``links`` (columns ``a, b`` of long; order and
    repeats don't matter, self links and nulls are ignored). Nodes without links don't appear."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        edges = written(_small_star(_large_star(edges)), "links")
    # a star per component remains: b -> its least id a
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
