"""Compiling dated tables into slices, and gathering what an entity refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.operators.intervals import elementary
from terrachron.operators.matching import segment_distance
from terrachron.sources.shared import settled

#: Fixed value: kilometres of a degree for short distances.
KM_PER_DEGREE = 111.195


def _row_of(slices: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """slices (object_id, lo, hi) with the value of the object's first row (object_id, lo, hi, ord, value) that holds each; slices without one are left out."""
    r = rows.select("object_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "ord", value)
    held = slices.join(r, "object_id").where((F.col("_lo") <= F.col("lo")) & (F.col("_hi") >= F.col("hi")))
    return held.groupBy("object_id", "lo", "hi").agg(F.min_by(F.struct(value), "ord").alias("_v")).select("object_id", "lo", "hi", f"_v.{value}")


def compile_world(lifetimes: DataFrame, geometries: DataFrame, parents: DataFrame) -> DataFrame:
    """(object_id, lo, hi, geom_id, parent_id): the slices (hi excluded) in which an object lives, has a shape, and all above it do too.

    The tables have (object_id, lo, hi, ord) and geom_id or parent_id; lo and hi are not null. An object is cut where any
    of its own rows begins or ends; in each slice its first row in order counts, as does its first parent row. From the
    roots down, a slice keeps the parts in which its parent is there: one join for each level. What hangs on a cycle or
    a missing parent isn't reached and goes. Pieces that a parent's slices cut stay apart.
    """
    bounds = [t.select("object_id", "lo", "hi") for t in (lifetimes, geometries, parents)]
    cuts = elementary(bounds[0].union(bounds[1]).union(bounds[2]), ["object_id"], [F.col("lo"), F.col("hi")])
    alive = _row_of(cuts, lifetimes.withColumn("_alive", F.lit(True)), "_alive").drop("_alive")
    shaped = _row_of(alive, geometries, "geom_id")
    above = _row_of(cuts, parents, "parent_id")
    slices = settled(shaped.join(above, ["object_id", "lo", "hi"], "left"))
    found = [settled(slices.where("parent_id is null"))]
    hanging = slices.where("parent_id is not null")
    while found[-1].take(1):
        up = found[-1].select(F.col("object_id").alias("parent_id"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        below = hanging.join(up, "parent_id").where((F.col("lo") < F.col("_hi")) & (F.col("_lo") < F.col("hi")))
        found.append(settled(below.select("object_id", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"), "geom_id", "parent_id")))
    out = found[0].select("object_id", "lo", "hi", "geom_id", "parent_id")
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def materialised(entities: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (entity_id, refs: array of (id, version)) with their payloads in the order of the refs, and the (entity_id, id, version) that are missing.

    An entity with a missing payload isn't in the first table; one without refs has an empty list.
    """
    asked = entities.select("entity_id", F.posexplode("refs").alias("pos", "ref")).select("entity_id", "pos", "ref.id", "ref.version")
    both = asked.join(payloads.select("id", "version", F.struct("payload").alias("_p")), ["id", "version"], "left")
    lost = both.where("_p is null").select("entity_id", "id", "version")
    gathered = both.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_p.payload"))).alias("_g"), F.bool_and(F.col("_p").isNotNull()).alias("_whole"))
    whole = entities.select("entity_id").join(gathered, "entity_id", "left").where(F.coalesce("_whole", F.lit(True)))
    kind = f"array<{payloads.schema['payload'].dataType.simpleString()}>"
    return whole.select("entity_id", F.coalesce(F.col("_g.payload"), F.array().cast(kind)).alias("payloads")), lost


def library_search(rows: DataFrame, names: str, query: str, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Rows of a kind and status with a name (array) that holds the query, case ignored for A-Z only; a blank query finds all."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = rows if kind is None else rows.where(F.col("kind") == kind)
    out = out if status is None else out.where(F.col("status") == status)
    asked = query.strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return out.where(F.exists(names, lambda n: F.contains(lower(n), F.lit(asked)))) if asked else out


def presence(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(group, present): whether each token (group, token) of a group is part of some name (group, name) of it."""
    each = tokens.join(names, "group", "left").groupBy("group", "token").agg(F.coalesce(F.bool_or(F.contains("name", "token")), F.lit(False)).alias("_there"))
    return each.groupBy("group").agg(F.bool_and("_there").alias("present"))


def local_segment_km(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Kilometres from a point to a segment near it: degrees of longitude shrink by the point's latitude."""
    shrink = F.cos(F.radians(lat))
    return segment_distance(lon * shrink, lat, x1 * shrink, y1, x2 * shrink, y2) * KM_PER_DEGREE
