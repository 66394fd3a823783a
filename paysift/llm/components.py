"""Connected components by alternating star operations.

Each round points every node of the edge list at the smallest node that it knows (large star
over greater neighbours, small star over lesser ones). Neighbour minima are plain aggregates,
so a node with very many edges is summed map-side and no neighbour list is ever gathered.
The edge list is checkpointed after every round, into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v), u > v. Large star: greater neighbours of u get u's least neighbour.
    Small star: lesser neighbours of u, and u, get it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable from each node that has a link to another."""
    edges = cut_lineage(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = cut_lineage(_star(_star(edges, True), False).distinct())
    linked = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return linked.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
