"""Records of a dated library: names at a date, bindings, checks of its tables, its manifests and its reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.functions.names import finished_hydronym, squeezed, stripped_hydronym
from terrachron.operators.hierarchy import roots
from terrachron.operators.intervals import coalesced
from terrachron.sources.shared import dealt


def hydronyms(rows: DataFrame, aliases: DataFrame, name: str, category: str) -> DataFrame:
    """rows with `hydronym`. aliases: (alias, name), one row for an alias; looked up before and after a name's endings are dealt with.

    A null or blank name gives an empty text.
    """
    known = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_known"))

    def looked_up(df: DataFrame) -> DataFrame:
        return df.join(known, F.col("_v") == F.col("_alias"), "left").withColumn("_v", F.coalesce("_known", "_v")).drop("_alias", "_known")

    first = looked_up(rows.withColumn("_v", F.coalesce(squeezed(F.col(name)), F.lit(""))))
    second = looked_up(first.withColumn("_v", F.when(F.col("_v") != "", stripped_hydronym(F.col("_v"))).otherwise("")))
    return second.withColumn("hydronym", F.when(F.col("_v") != "", finished_hydronym(F.col("_v"), F.col(category))).otherwise("")).drop("_v")


def system_names(candidates: DataFrame) -> DataFrame:
    """One row for each system of candidates (system, rank, name): its best name, whether it has one, and its other names in order.

    The least rank wins, of equal ranks the least name; a system without names is named by its number.
    """
    named = F.when(F.trim("name") != "", F.struct("rank", "name"))
    of = candidates.groupBy("system").agg(F.min(named)["name"].alias("best"), F.array_sort(F.collect_set(F.nullif(F.trim("name"), F.lit("")))).alias("all"))
    fallback = F.concat(F.lit("미명명 수계 "), F.col("system").cast("string"))
    return of.select("system", F.coalesce("best", fallback).alias("name"), F.col("best").isNotNull().alias("named"), F.array_remove("all", F.coalesce("best", F.lit(""))).alias("others"))


def names_at(versions: DataFrame, day: int | None) -> DataFrame:
    """One row for each entity of versions (entity_id, lo, hi, name, names: an array): the name at a day, and all distinct names as first seen.

    Without a day the version with the latest start counts. An entity without a version then has a null name.
    """
    held = F.lit(True) if day is None else (F.coalesce(F.col("lo"), F.lit(day)) <= day) & (F.coalesce(F.col("hi"), F.lit(day)) >= day)
    picked = F.max(F.when(held, F.struct(F.coalesce("lo", F.lit(-(2**62))).alias("lo"), "name")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("lo", F.lit(-(2**62))).alias("lo"), "names"))), lambda v: v["names"])
    return versions.groupBy("entity_id").agg(picked["name"].alias("name"), F.array_distinct(F.flatten(listed)).alias("search_names"))


def bindings(versions: DataFrame, lifetimes: DataFrame, key: str) -> DataFrame:
    """versions cut to the lifetimes (key, born, died) of their entities, without what lies outside; null bounds are open."""
    lives = lifetimes.select(F.col(key).alias("_of"), "born", "died")
    lo, hi = F.greatest("lo", "born"), F.least("hi", "died")
    return versions.join(lives, F.col(key) == F.col("_of")).where(F.coalesce(lo <= hi, F.lit(True))).withColumns({"lo": lo, "hi": hi}).drop("_of", "born", "died")


def with_active_properties(entities: DataFrame, active: DataFrame, key: str, properties: dict[str, str]) -> DataFrame:
    """entities with the columns of `properties` (column: property) from active rows (key, property, value) where there is one."""
    of = active.groupBy(F.col(key).alias("_of")).agg(*(F.max(F.when(F.col("property") == p, F.col("value"))).alias(f"_{c}") for c, p in properties.items()))
    out = entities.join(of, F.col(key) == F.col("_of"), "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in properties}).drop("_of", *(f"_{c}" for c in properties))


def _issue(rows: DataFrame, id: Column | str, code: str) -> DataFrame:
    return rows.select((F.col(id) if isinstance(id, str) else id).cast("string").alias("id"), F.lit(code).alias("issue"))


def _uncovered(rows: DataFrame, spans: DataFrame, owner: str) -> DataFrame:
    """Rows that no span (owner, lo, hi) of the row's `owner` holds whole."""
    s = spans.select(F.col("owner").alias("_o"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return rows.join(s, (F.col(owner) == F.col("_o")) & (F.col("_lo") <= F.col("lo")) & (F.col("_hi") >= F.col("hi")), "left_anti")


def record_issues(lifetimes: DataFrame, geometries: DataFrame, parents: DataFrame) -> DataFrame:
    """What is wrong with dated records, as (id, issue).

    All three tables have id, object_id, lo and hi (last day, as numbers of days); parents have parent_id. Issues: overlap
    (of a table's records of one object), outside lifetime, gap (of geometries within one), inactive parent, cycle (an
    object that is its own parent).
    """
    lifetimes, geometries, parents = (dealt(rows, "object_id") for rows in (lifetimes, geometries, parents))
    end = F.col("lo") <= F.col("_reach") + 1
    merged = lambda rows: coalesced(rows, ["object_id"], "lo", "hi", end, ["id"]).select(F.col("object_id").alias("owner"), "lo", "hi")
    lives, shown = merged(lifetimes), merged(geometries)
    before = Window.partitionBy("object_id").orderBy("lo", "id").rowsBetween(Window.unboundedPreceding, -1)
    overlap = lambda rows: rows.withColumn("_reach", F.max("hi").over(before)).where("lo <= _reach")
    bare = _uncovered(lives.withColumn("object_id", F.col("owner")), shown, "object_id")
    found = [
        *(_issue(overlap(rows), "id", "overlap") for rows in (lifetimes, geometries, parents)),
        *(_issue(_uncovered(rows, lives, "object_id"), "id", "outside lifetime") for rows in (geometries, parents)),
        _issue(bare.select("object_id").distinct(), "object_id", "gap"),
        _issue(_uncovered(parents.where("parent_id is not null"), lives, "parent_id"), "id", "inactive parent"),
        _issue(parents.where("parent_id = object_id"), "id", "cycle"),
    ]
    return reduce(DataFrame.union, found)


def lineage_issues(entities: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """What is wrong with a library's index, as (id, issue).

    entities: entity_id, lineage_id, parent_id. members: lineage_id, entity_id. relations: source, target. Issues:
    duplicate entity, unknown member, member twice, other lineage, no lineage, missing end, missing parent, cycle.
    """
    known = entities.select(F.col("entity_id").alias("_id"), F.col("lineage_id").alias("_lineage")).dropDuplicates(["_id"])
    with_entity = members.join(known, F.col("entity_id") == F.col("_id"), "left")
    ends = relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("end")).distinct()
    parents = entities.where("parent_id is not null").select("entity_id", "parent_id")
    lines = roots(entities.dropDuplicates(["entity_id"]).select(F.col("entity_id").alias("id"), "parent_id"))
    found = [
        _issue(entities.groupBy("entity_id").count().where("count > 1"), "entity_id", "duplicate entity"),
        _issue(with_entity.where("_id is null").select("entity_id").distinct(), "entity_id", "unknown member"),
        _issue(members.groupBy("entity_id").count().where("count > 1"), "entity_id", "member twice"),
        _issue(with_entity.where("_id is not null and not (lineage_id <=> _lineage)").select("entity_id").distinct(), "entity_id", "other lineage"),
        _issue(known.join(members.select("entity_id"), F.col("_id") == F.col("entity_id"), "left_anti"), "_id", "no lineage"),
        _issue(ends.join(known, F.col("end") == F.col("_id"), "left_anti"), "end", "missing end"),
        _issue(parents.join(known, F.col("parent_id") == F.col("_id"), "left_anti"), "entity_id", "missing parent"),
        _issue(lines.where("state = 'Cycle'"), "id", "cycle"),
    ]
    return reduce(DataFrame.union, found)


def manifest_issues(tiles: DataFrame, shards: DataFrame, least: int = 32) -> DataFrame:
    """What is wrong with rows (key, shard, offset, length, sha256, first, last) of a manifest of shards (shard, bytes), as (id, issue).

    Issues: missing shard, range (outside of its shard or shorter than `least`), hash, order (first name after the last).
    """
    rows = tiles.join(shards.select(F.col("shard").alias("_shard"), "bytes"), F.col("shard") == F.col("_shard"), "left")
    inside = (F.col("offset") >= 0) & (F.col("length") >= least) & (F.col("offset") + F.col("length") <= F.col("bytes"))
    wrong = {
        "missing shard": F.col("_shard").isNull(), "range": F.col("_shard").isNotNull() & ~F.coalesce(inside, F.lit(False)),
        "hash": ~F.coalesce(F.col("sha256").rlike(r"\A[a-f0-9]{64}\z"), F.lit(False)), "order": F.coalesce(F.col("first") > F.col("last"), F.lit(False)),
    }
    issues = F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in wrong.items()))))
    return rows.select(F.col("key").cast("string").alias("id"), issues.alias("issue"))


def source_consistency(features: DataFrame, declared: DataFrame, source: str, id: str) -> DataFrame:
    """For each declared source (source, n): its features and distinct ids, and whether both are n."""
    found = features.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("features"), F.countDistinct(id).alias("ids"))
    out = declared.join(found, F.col("source") == F.col("_source"), "left").select("source", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "ids")))
    return out.withColumn("consistent", (F.col("features") == F.col("n")) & (F.col("ids") == F.col("n")))


def review_history(rows: DataFrame) -> DataFrame:
    """rows of reviews with `position`, their place in the history of their entity; open bounds come first."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    order = ["created_at", "proposal_id", "kind", "field", blank("valid_from"), blank("valid_to")]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))


def reused_payloads(before: DataFrame, after: DataFrame, key: str, geometry: str) -> DataFrame:
    """after without its geometry, with `reused`: whether the key had an equal geometry before (two nulls are equal)."""
    was = before.select(F.col(key).alias("_of"), F.xxhash64(geometry).alias("_was"))
    out = after.withColumn("_is", F.xxhash64(geometry)).join(was, F.col(key) == F.col("_of"), "left")
    return out.withColumn("reused", F.coalesce(F.col("_was") == F.col("_is"), F.lit(False))).drop("_of", "_was", "_is", geometry)


def chain_counts(reaches: DataFrame) -> DataFrame:
    """One row: reaches, chains and coordinates of the reaches (id, next, stage, coordinates, position) that have a stage.

    A reach goes on into the next one if both have one stage and it is the only such reach above it; each reach of a ring is
    a chain. A last reach at a position before its chain's first one counts once more, as chains are counted in order.
    """
    chosen = reaches.where("stage is not null")
    below = chosen.select(F.col("id").alias("_next"), F.col("stage").alias("_stage"))
    links = chosen.join(below, (F.col("next") == F.col("_next")) & (F.col("stage") == F.col("_stage"))).select("id", "next")
    only = links.groupBy(F.col("next").alias("_of")).agg(F.count("*").alias("n"), F.first("id").alias("parent_id")).where("n = 1")
    lines = roots(chosen.join(only, F.col("id") == F.col("_of"), "left").select("id", "parent_id"))
    starts = lines.where("state = 'Cycle' or steps = 0").select("id")
    at = chosen.select(F.col("id").alias("_id"), "position")
    last = lines.where("steps > 0").join(links.select("id"), "id", "left_anti").join(at.withColumnRenamed("position", "_last"), F.col("id") == F.col("_id")).drop("_id")
    early = last.join(at, F.col("root_id") == F.col("_id")).where("_last < position").select("id")
    rows = chosen.select(F.lit(1).alias("reach"), F.lit(0).alias("chain"), F.col("coordinates").cast("long").alias("c"))
    rows = rows.union(starts.union(early).select(F.lit(0), F.lit(1), F.lit(0).cast("long")))
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("reach", "reaches"), ("chain", "chains"), ("c", "coordinates"))))


def composed_polygons(parts: DataFrame, key: str, order: list[str], polygons: str) -> DataFrame:
    """One row for each key: all its polygons in order of its parts. What is gathered is one shape."""
    listed = F.array_sort(F.collect_list(F.struct(*order, polygons)))
    return parts.groupBy(key).agg(F.flatten(F.transform(listed, lambda p: p[polygons])).alias(polygons))
