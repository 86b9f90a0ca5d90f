"""The dated world: lifetimes, geometry bindings, parent relations and properties, resolved at a month.

The four tables have (object_id, lo, hi, ord) and their payload; lo and hi are packed days, ord is the input order. A
constant month is a filter on each table, so only active rows are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.functions import temporal
from terrachron.operators.hierarchy import ancestors
from terrachron.operators.intervals import first_active


def with_bounds(df: DataFrame, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """df with lo and hi; rows with an invalid or reversed interval are left out (`invalid_intervals` reports them)."""
    return df.withColumn("_i", temporal.interval(F.col(valid_from), F.col(valid_to))).where("_i is not null").withColumns({"lo": F.col("_i.lo"), "hi": F.col("_i.hi")}).drop("_i")


def invalid_intervals(df: DataFrame, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    return df.where(temporal.interval(F.col(valid_from), F.col(valid_to)).isNull())


def active_at(df: DataFrame, month: str) -> DataFrame:
    """Each object's first row that holds the month's last day."""
    end = temporal.constant_month_end(month)
    return first_active(df, ["object_id"], temporal.contains_end(F.col("lo"), F.col("hi"), end), ["ord"])


def resolve_world(lifetimes: DataFrame, geometries: DataFrame, parents: DataFrame, properties: DataFrame, month: str) -> DataFrame:
    """One row for each object that lives and has a geometry: object_id, geom_id, geom_version, parent_id, name, ancestors, root_id."""
    alive = active_at(lifetimes, month).select("object_id")
    shape = active_at(geometries, month).select("object_id", "geom_id", "geom_version")
    above = active_at(parents, month).select("object_id", "parent_id")
    names = active_at(properties.where("property = 'name'"), month).select("object_id", F.col("value").alias("name"))
    world = alive.join(shape, "object_id").join(above, "object_id", "left").join(names, "object_id", "left")
    lines = ancestors(world.select(F.col("object_id").alias("id"), "parent_id"))
    return world.join(lines.withColumnRenamed("id", "object_id"), "object_id", "left")


def availability(objects: DataFrame, lifetimes: DataFrame, geometries: DataFrame, month: str) -> DataFrame:
    """objects (object_id) with `state`: Available (alive, with a shape), Absent (not alive), GeometryGap or, for a life without bounds, Unknown."""
    bounded = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    alive = active_at(lifetimes, month).select("object_id", bounded.alias("_bounded"))
    shaped = active_at(geometries, month).select("object_id", F.lit(True).alias("_shaped"))
    out = objects.join(alive, "object_id", "left").join(shaped, "object_id", "left")
    state = F.when(F.col("_bounded").isNull(), "Absent").when(F.col("_shaped"), "Available").when(F.col("_bounded"), "GeometryGap").otherwise("Unknown")
    return out.select("object_id", state.alias("state"))


def split_at(df: DataFrame, month: str) -> DataFrame:
    """Each row that spans a month's first day as two rows, before and from it; `part` tells which."""
    first, previous_end = temporal.constant_start(month), temporal.day_before(month)
    spans = (F.col("lo") < first) & (F.col("hi") >= first)
    halves = F.array(
        F.struct(F.lit("before").alias("part"), F.col("lo").alias("lo"), previous_end.alias("hi")),
        F.struct(F.lit("after").alias("part"), first.alias("lo"), F.col("hi").alias("hi")),
    )
    whole = F.array(F.struct(F.lit("whole").alias("part"), F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    out = df.withColumn("_halves", F.explode(F.when(spans, halves).otherwise(whole)))
    return out.withColumns({c: F.col(f"_halves.{c}") for c in ("part", "lo", "hi")}).drop("_halves")


def truncate_at(df: DataFrame, month: str) -> DataFrame:
    """Rows cut off from a month on: those that begin later go, those that span it end before it."""
    return split_at(df, month).where((F.col("part") != "after") & (F.col("lo") < temporal.constant_start(month))).drop("part")
