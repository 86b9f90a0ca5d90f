"""Connected parts of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.sources.shared import settled


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of `nodes` (id) reaches over links (a, b: any order) among them.

    Each round, a node points to the least label among its neighbours' and its own, and then to that label's label, so
    distances halve. Labels are written to the shared folder after each round.
    """
    both = links.where("a <> b").select("a", "b")
    both = both.union(both.select("b", "a")).distinct()
    both = settled(both.join(nodes.select(F.col("id").alias("a")).distinct(), "a", "left_semi").join(nodes.select(F.col("id").alias("b")).distinct(), "b", "left_semi"))
    now = settled(nodes.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        label = now.select(F.col("id").alias("b"), F.col("component").alias("near"))
        least = both.join(label, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = now.join(least, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        now = settled(step.join(jump, "to").select("id", "old", F.least("to", "further").alias("component")))
        if not now.where("old <> component").take(1):
            return now.select("id", "component")
        now = now.select("id", "component")


def is_connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: how many nodes and parts, and whether the nodes hang together (one part)."""
    return connected(nodes, links).agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts")).withColumn("connected", F.col("parts") == 1)
