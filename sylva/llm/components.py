"""Connected components of an edge table by alternating star steps.

Large-star links the larger neighbours of each vertex to its smallest neighbour,
small-star the smaller ones; both keep what is connected and end in stars around
the smallest vertex of each component. Every round is a pair of shuffles over the
edges alone, staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) of every vertex that has an edge to another; a root is the
    smallest vertex of its component and has a row of its own."""
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    with scratch(edges.sparkSession) as kept:
        now = stage(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
        seen = now.agg(mark.alias("m")).first()[0]
        while seen["n"]:
            now = stage(_small_star(_large_star(now)), "edges")
            mark_now = now.agg(mark.alias("m")).first()[0]
            if mark_now == seen:
                break
            seen = mark_now
        kept.append(now)
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("vertex"), "root").distinct())
