"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) joined back to the edges, so a
vertex with very many neighbours is split like any skewed join. Each step's edges are written
to the shared folder; nothing of the graph reaches the driver but a count and a checksum.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with an edge (u, v); the component is its least vertex.

    Self-loops and NULL ends are left out; an empty table gives an empty result.
    """
    edges = materialise(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = _print(edges)
    while before[0]:
        large = materialise(_large_star(edges), "large")
        small = materialise(_small_star(large), "small")
        forget(edges, large)
        edges = small
        now = _print(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
