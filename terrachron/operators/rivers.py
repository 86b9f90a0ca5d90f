"""River networks: reaches (id, next_id, ...) form a forest that flows towards its roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terrachron.operators.hierarchy import propagate_max, roots


def scored(reaches: DataFrame) -> DataFrame:
    """reaches (ord, flow, upstream_area) with score and width."""
    score = F.col("ord") + 4 * F.log10(F.greatest("flow", F.lit(1e-6))) - 0.5 * F.log10(F.greatest("upstream_area", F.lit(1e-6)))
    width = F.greatest(F.lit(0.55), F.least(F.lit(2.6), 0.55 + 0.35 * F.log10(1 + F.greatest("flow", F.lit(0.0)))))
    return reaches.withColumn("score", score).withColumn("width", width)


def best_upstream(reaches: DataFrame, k: int = 8) -> DataFrame:
    """Each reach's k best tributaries by area, flow and id, with their rank."""
    w = Window.partitionBy("next_id").orderBy(F.desc("upstream_area"), F.desc("flow"), F.desc("id"))
    return reaches.where("next_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def systems(reaches: DataFrame) -> DataFrame:
    """reaches with system_id (the outlet), its depth above the outlet, and state (Valid, Missing, Cycle)."""
    ends = roots(reaches.select("id", F.col("next_id").alias("parent_id")))
    return reaches.join(ends.select("id", F.col("root_id").alias("system_id"), F.col("steps").cast("int").alias("steps"), "state"), "id")


def chains(reaches: DataFrame) -> DataFrame:
    """reaches with chain_id and position: a chain follows each reach's best tributary upwards, so it begins at an outlet or beside another chain.

    The chain of a reach is found by doubling along the links between a reach and the one that it continues.
    """
    best = best_upstream(reaches, 1).select("id", F.col("next_id").alias("parent_id"))
    links = reaches.select("id").join(best, "id", "left")
    return reaches.join(roots(links).select("id", F.col("root_id").alias("chain_id"), F.col("steps").cast("int").alias("position")), "id")


def excluded_basins(reaches: DataFrame, terminals: DataFrame) -> DataFrame:
    """reaches without all that flows into the given terminals (id)."""
    gone = systems(reaches).join(terminals.select(F.col("id").alias("system_id")), "system_id", "left_semi").select("id")
    return reaches.join(gone, "id", "left_anti")


def widths_downstream(reaches: DataFrame, width: str = "width") -> DataFrame:
    """(id, width): the greatest width of a reach and all above it. Reaches that flow round a cycle are left out."""
    return propagate_max(reaches.select("id", F.col("next_id").alias("parent_id"), F.col(width).alias("width")), "width")


def fragments(reaches: DataFrame, order: list[str], *marks: str) -> DataFrame:
    """reaches of a chain with `fragment`: a new one starts where a mark differs from the reach before (null-safe)."""
    w = Window.partitionBy("chain_id").orderBy(*order)
    changed = F.lit(False)
    for m in marks:
        changed = changed | ~F.col(m).eqNullSafe(F.lag(m).over(w))
    first = F.row_number().over(w) == 1
    return reaches.withColumn("_new", (changed | first).cast("int")).withColumn("fragment", F.sum("_new").over(w)).drop("_new")
