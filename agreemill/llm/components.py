"""Connected components of an edge table, by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., 2014) with joins and partial
aggregates only: no neighbour list is ever gathered in one place, and a hub's
rows stay splittable. Each round is checkpointed in the shared folder.

Edge cases: self-loops, repeated edges and null ends add nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, fresh

MAX_ROUNDS = 60
ROWS_A_FILE = 200_000


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour.

    The least neighbours are written first: a join of two plain tables is one
    whose hot keys (hubs) an adaptive plan can split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), files)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpoint(down.groupBy("u").agg(F.min("v").alias("m")), files)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _settled(edges: DataFrame, rows: int) -> bool:
    """Are the edges (u, v) stars, each u with one v that is no u itself?"""
    nodes = edges.select("u").distinct()
    return nodes.count() == rows and not edges.join(nodes.withColumnRenamed("u", "v"), "v", "left_semi").head(1)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another one;
    component is the smallest node it can reach."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    now = fresh(checkpoint(now))
    rows = now.count()
    for _ in range(MAX_ROUNDS):
        if _settled(now, rows):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        files = 1 + rows // ROWS_A_FILE
        large = checkpoint(_large_star(now, files), files)
        now = fresh(checkpoint(_small_star(large, files), files))
        rows = now.count()
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
