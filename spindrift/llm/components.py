"""Connected components of a graph of edges, as joins and aggregates (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) with u > v: each node's larger neighbours move to the least of the node and its neighbours."""
    ends = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("m"))
    return edges.join(least, F.col("v") == F.col("node")).select("u", F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """The same of each node itself and its smaller neighbours: the edge to the least one stays, as the node's own."""
    met = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    return met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (u, v); the component is its least node. Nodes without edges are left out."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    for _ in range(rounds):
        # Each step is written, as a plan of both holds the first one several times, which the driver plans anew at every stage.
        now = stored(small_star(stored(large_star(now), name)), name)
        # A fixed point is a forest of stars; its sums say so without moving it.
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
