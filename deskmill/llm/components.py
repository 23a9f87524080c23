"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.session import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(turned)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest of them all."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return others.unionByName(own).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(vertex, component)`` of every vertex with an edge; the component is its
    smallest vertex.

    Vertices are longs. Each round is written to the checkpoint folder, so the
    lineage stays short; rounds grow with the logarithm of the largest component.
    Only two numbers per round come to the driver. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    state = durable(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(state)
    while seen[0]:
        state = durable(_small_star(_large_star(state)))
        now = _mark(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def _mark(state: DataFrame) -> tuple:
    """Rows and a sum over them that changes with any of them."""
    mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = state.agg(F.count("*").alias("n"), F.sum(mixed).alias("s")).first()
    return row.n, row.s
