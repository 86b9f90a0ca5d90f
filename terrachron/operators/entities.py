"""Entities with dated versions: references, allowed fields, representatives, statuses, retirement, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.operators.hierarchy import roots


def reference_key(domain: Column, kind: Column, id: Column) -> Column:
    """The canonical text of a reference; an id with reserved characters is url-encoded."""
    return F.concat_ws(":", domain, kind, F.url_encode(id))


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """The keys of a JSON object that aren't allowed, in order; null where the text is no object."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def representatives(versions: DataFrame, chosen: DataFrame, key: str = "entity_id", version: str = "version_id") -> DataFrame:
    """(key, version, issue): the chosen version, else the only one; without either, `issue` says why (unknown version, ambiguous)."""
    every = versions.groupBy(key).agg(F.count("*").alias("_n"), F.min(version).alias("_only"))
    asked = chosen.select(key, F.col(version).alias("_asked"))
    found = asked.join(versions.select(key, F.col(version).alias("_asked")).distinct().withColumn("_there", F.lit(True)), [key, "_asked"], "left")
    rows = every.join(found, key, "left")
    own = F.when(F.col("_there"), F.col("_asked")).when(F.col("_asked").isNull() & (F.col("_n") == 1), F.col("_only"))
    issue = F.when(own.isNotNull(), F.lit(None)).when(F.col("_asked").isNotNull(), "unknown version").otherwise("ambiguous")
    return rows.select(key, own.alias(version), issue.alias("issue"))


def only_properties_changed(before: DataFrame, after: DataFrame, key: str, free: list[str]) -> DataFrame:
    """(key, property_only) of rows that differ: whether they are equal but for the free columns. Null-safe."""
    rest = [c for c in before.columns if c not in (key, *free)]
    both = before.select(key, F.struct(*rest).alias("_a"), F.struct(*free).alias("_x")).join(after.select(key, F.struct(*rest).alias("_b"), F.struct(*free).alias("_y")), key)
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return both.where(~same | ~F.col("_x").eqNullSafe(F.col("_y"))).select(key, same.alias("property_only"))


def geometry_version(versions: DataFrame, key: str, start: str, end: str, at: int, order: str) -> DataFrame:
    """Each key's version at a year: the latest start among those that hold it, else the nearest by its start, else the last; the first in order on ties.

    A null start or end is open; a version without a start is nearest to nothing.
    """
    s, e = F.col(start), F.col(end)
    holds = (s.isNull() | (s <= at)) & (e.isNull() | (e >= at))
    w = Window.partitionBy(key).orderBy(F.desc(holds), F.when(holds, s).desc_nulls_last(), F.when(~holds, F.abs(s - at)).asc_nulls_last(), F.asc(order))
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def entities_at(coverage: DataFrame, key: str, lo: str, hi: str, day: int) -> DataFrame:
    """The entities with any coverage interval (closed) that holds a day, each once."""
    return coverage.where((F.col(lo) <= day) & (F.col(hi) >= day)).select(key).distinct()


def static_document(objects: DataFrame, records: DataFrame, key: str, lo: str, hi: str, order: str, day: int) -> DataFrame:
    """Each object's one record: the first in order that holds the day, else its first at all, `hidden`. Objects without records are left out."""
    active = (F.col(lo) <= day) & (F.col(hi) >= day)
    w = Window.partitionBy(key).orderBy(F.desc(active), order)
    one = records.withColumn("hidden", ~active).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return objects.select(key).join(one, key)


def initial_month(*tables: DataFrame, start: str = "lo", canonical: str = "valid_from") -> DataFrame:
    """One row: the canonical text of the latest start over several tables; null without any."""
    every = None
    for t in tables:
        part = t.where(F.col(start).isNotNull()).select(F.col(start).alias("_s"), F.col(canonical).alias("_c"))
        every = part if every is None else every.union(part)
    return every.agg(F.max(F.struct("_s", "_c")).alias("m")).select(F.substring("m._c", 1, 7).alias("month"))


def reference_status(entries: DataFrame, known: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """entries (entry, key, value) with four flags: known, active, blank (no value), repeated (its key occurs in several entries)."""
    there = known.select(key).distinct().withColumn("_k", F.lit(True))
    on = active.select(key).distinct().withColumn("_a", F.lit(True))
    often = entries.groupBy(key).agg((F.count("*") > 1).alias("repeated"))
    rows = entries.join(there, key, "left").join(on, key, "left").join(often, key, "left")
    return rows.select("entry", key, F.coalesce("_k", F.lit(False)).alias("known"), F.coalesce("_a", F.lit(False)).alias("active"), F.col("value").isNull().alias("blank"), F.coalesce("repeated", F.lit(False)).alias("repeated"))


def retired(nodes: DataFrame, gone: DataFrame, inbound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without ids, and a receipt (id, outcome) for each one asked: removed, unknown, or referenced by rows (source, id) that stay."""
    asked = gone.select("id").distinct()
    there = asked.join(nodes.select("id"), "id", "left_semi")
    held = inbound.join(asked.select(F.col("id").alias("source")), "source", "left_anti").select("id").distinct().withColumn("_held", F.lit(True))
    receipts = asked.join(there.withColumn("_there", F.lit(True)), "id", "left").join(held, "id", "left")
    receipts = receipts.select("id", F.when(F.col("_there").isNull(), "unknown").when(F.col("_held"), "referenced").otherwise("removed").alias("outcome"))
    return nodes.join(receipts.where("outcome = 'removed'").select("id"), "id", "left_anti"), receipts


def appended_versions(store: DataFrame, new: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """store (id, version, content) with new versions, and the refusals: a version that exists with other content, or comes twice with different ones.

    A version that exists with the same content is used again and not appended.
    """
    fresh = new.groupBy("id", "version").agg(F.min(content).alias(content), (F.count_distinct(content) > 1).alias("_torn"))
    both = fresh.join(store.select("id", "version", F.col(content).alias("_old")), ["id", "version"], "left")
    bad = F.col("_torn") | (F.col("_old").isNotNull() & (F.col("_old") != F.col(content)))
    refused = both.where(bad).select("id", "version", F.when(F.col("_torn"), "torn").otherwise("exists").alias("issue"))
    return store.unionByName(both.where(~bad & F.col("_old").isNull()).select(*store.columns)), refused


def evidence_by_entity(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, n, kinds): how many rows an entity has and their distinct kinds, in order."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def hierarchy_issues(nodes: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """(id, issue) of nodes (id, parent_id, kind): `kinds` says below which kinds a kind may stand ([] for roots).

    Issues: unknown kind, parent kind, missing parent, cycle. One row for each issue.
    """
    above = nodes.select(F.col("id").alias("parent_id"), F.col("kind").alias("_above"))
    rows = nodes.join(above, "parent_id", "left").join(roots(nodes).select("id", "state"), "id", "left")
    allowed = F.lit(False)
    for kind, parents in kinds.items():
        fits = F.col("parent_id").isNull() if not parents else F.col("parent_id").isNull() | F.col("_above").isNull() | F.col("_above").isin(*parents)
        allowed = allowed | ((F.col("kind") == kind) & fits)
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    issues = F.array(
        F.when(~known, "unknown kind"), F.when(known & ~allowed, "parent kind"),
        F.when(F.col("parent_id").isNotNull() & F.col("_above").isNull(), "missing parent"), F.when(F.col("state") == "Cycle", "cycle"),
    )
    return rows.select("id", F.explode(F.array_compact(issues)).alias("issue"))


def residual_share(weight: Column, duplicate: Column) -> Column:
    """The weighed share of duplicates, 0 without weight; an aggregate."""
    return F.coalesce(F.sum(weight * duplicate) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def extrapolated(count: Column, sampled: Column, whole: Column | int) -> Column:
    """A count in a sample carried to the whole that the sample is of; null for an empty sample."""
    return count / F.nullif(sampled, F.lit(0)) * whole


def supplement_diff(primary: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    """One row of counts: ids of the supplement that are new, changed or equal, and primary ids absent from it."""
    rest = [c for c in primary.columns if c != key]
    a = primary.select(key, F.struct(*rest).alias("_a"), F.lit(1).alias("_p"))
    b = supplement.select(key, F.struct(*rest).alias("_b"), F.lit(1).alias("_s"))
    both = a.join(b, key, "full_outer")
    there = F.col("_p").isNotNull() & F.col("_s").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(F.count_if(F.col("_p").isNull()).alias("new"), F.count_if(there & ~same).alias("changed"), F.count_if(there & same).alias("equal"), F.count_if(F.col("_s").isNull()).alias("absent"))


def sample_indices(n: Column, most: int) -> Column:
    """Evenly spaced indices of n things, `most` at most, as an array; empty for none."""
    m = F.least(n, F.lit(most)).cast("int")
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * n / m).cast("int"))).otherwise(F.array().cast("array<int>"))
