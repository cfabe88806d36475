"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay in Spark; the driver sees a count and a checksum a round.  A vertex with a third of all edges is
pre-aggregated to its smallest neighbour, and the join that brings this back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger to the smaller vertex."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every vertex with an edge; the component's name is its smallest vertex."""
    now = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    now, mark = stored(now, "edges"), None
    while (new := _mark(now)) != mark:
        mark = new
        if not mark[0]:
            break
        now = stored(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
