"""Guarded edits of hierarchies and dated properties; each gives a new table and leaves the old one as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.functions import temporal
from terrachron.operators.hierarchy import roots
from terrachron.sources.shared import settled


def created(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, parent_id, ...) with new rows, and the refusals (id, issue): an id that exists or repeats, a parent that doesn't exist."""
    known = nodes.select("id")
    every = known.union(new.select("id"))
    exists = new.join(known, "id", "left_semi").select("id", F.lit("exists").alias("issue"))
    repeats = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("issue"))
    orphan = new.where("parent_id is not null").join(every.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti").select("id", F.lit("no such parent").alias("issue"))
    refused = settled(exists.union(repeats).union(orphan).distinct())
    return nodes.unionByName(new.join(refused.select("id").distinct(), "id", "left_anti")), refused


def deleted(nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without ids, and the refusals: ids with children that would stay."""
    children = nodes.where("parent_id is not null").join(gone.select("id"), "id", "left_anti").select(F.col("parent_id").alias("id")).distinct()
    refused = settled(gone.join(children, "id", "left_semi").select("id", F.lit("has children").alias("issue")))
    return nodes.join(gone.join(refused, "id", "left_anti"), "id", "left_anti"), refused


def reparented(nodes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with new parents by moves (id, parent_id), and the refusals: moves that lead into a cycle or to a parent that doesn't exist."""
    to = moves.select("id", F.col("parent_id").alias("_to"), F.lit(True).alias("_moved"))
    rows = nodes.join(to, "id", "left").withColumn("parent_id", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("parent_id")))
    states = roots(rows.select("id", "parent_id")).where("state <> 'Valid'").select("id", "state")
    refused = settled(moves.join(states, "id").select("id", F.when(F.col("state") == "Cycle", "cycle").otherwise("no such parent").alias("issue")))
    back = nodes.select("id", F.col("parent_id").alias("_old")).join(refused.select("id", F.lit(True).alias("_refused")), "id", "left")
    kept = rows.drop("_to", "_moved").join(back, "id").withColumn("parent_id", F.when(F.col("_refused"), F.col("_old")).otherwise(F.col("parent_id")))
    return kept.select(*nodes.columns), refused


def dirty_ids(earlier: DataFrame, before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, rank): ids that were dirty, then removed or changed ones in their old order, then new ones; none twice.

    earlier and the tables have `ord`, their order.
    """
    old = before.select(key, F.col("ord").alias("_o"), F.col(version).alias("_v"))
    new = after.select(key, F.col("ord").alias("_n"), F.col(version).alias("_w"))
    both = old.join(new, key, "full_outer")
    changed = both.where(F.col("_o").isNotNull() & (F.col("_n").isNull() | ~F.col("_v").eqNullSafe(F.col("_w")))).select(key, F.lit(1).alias("part"), F.col("_o").alias("at"))
    added = both.where("_o is null").select(key, F.lit(2).alias("part"), F.col("_n").alias("at"))
    every = earlier.select(key, F.lit(0).alias("part"), F.col("ord").alias("at")).union(changed).union(added)
    return every.groupBy(key).agg(F.min(F.struct("part", "at")).alias("rank"))


def set_property(properties: DataFrame, lifetimes: DataFrame, changes: DataFrame, month: str) -> DataFrame:
    """properties (object_id, property, lo, hi, value) with changes (object_id, property, value) from a month on.

    A row that holds the month's end is cut before the month and goes on with the new value; a row that begins in the
    month or later and holds its end takes the value. Without such a row, a new one lasts until the next row of the
    property or the end of the lifetime that holds the month's end; objects that aren't alive then are left alone.
    """
    first, last, before = temporal.constant_start(month), temporal.constant_end(month), temporal.day_before(month)
    key = ["object_id", "property"]
    new = changes.select(*key, F.col("value").alias("_new"))
    rows = properties.join(new, key, "left")
    held = temporal.contains_end(F.col("lo"), F.col("hi"), last)
    touched = held & F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("value"))
    piece = lambda lo, hi, v: F.struct(lo.alias("lo"), hi.alias("hi"), v.alias("value"))
    lo, hi, value = F.col("lo"), F.col("hi"), F.col("value")
    pieces = (
        F.when(touched & (lo < first), F.array(piece(lo, before, value), piece(first, hi, F.col("_new"))))
        .when(touched, F.array(piece(lo, hi, F.col("_new"))))
        .otherwise(F.array(piece(lo, hi, value)))
    )
    kept = rows.withColumn("_p", F.explode(pieces)).select(*key, "_p.lo", "_p.hi", "_p.value")
    holders = properties.where(held).select(*key).distinct()
    missing = new.join(holders, key, "left_anti")
    alive = lifetimes.where(temporal.contains_end(F.col("lo"), F.col("hi"), last)).groupBy("object_id").agg(F.max(F.struct("hi", "lo")).alias("life"))
    coming = properties.where(F.col("lo") > first).groupBy(*key).agg(F.min("lo").alias("_next"))
    added = missing.join(alive, "object_id").join(coming, key, "left")
    end = F.least(F.col("life.hi"), F.coalesce(temporal.previous_day(F.col("_next")), F.col("life.hi")))
    return kept.union(added.select(*key, F.greatest(first, F.col("life.lo")).alias("lo"), end.alias("hi"), F.col("_new").alias("value")))
