"""Connected components of an edge table by alternating star contraction.

Each step is joins and minima over edges only; nothing is gathered in one place. A step's edges are written to the
shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.llm.common import counted, materialise


def connected_components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """links (a, b: any order, repeats allowed, nulls ignored) to (node, component) for every node that isn't its component's least."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    single = False
    for _ in range(max_steps):
        # Large star: a node's larger neighbours move to its least neighbour (or itself).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        large, n = counted(moved, F.col("moved"))
        # Each node has one edge, and none of them ends at a node with a smaller neighbour.
        if single and not n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        both = moved.union(least.select("a", F.col("m").alias("b"), F.lit(False).alias("moved")))
        edges, n = counted(both.groupBy("a", "b").agg(F.max("moved").alias("moved")), F.col("moved"))
        single, edges = not n, edges.select("a", "b")
    raise RuntimeError("components did not settle")
