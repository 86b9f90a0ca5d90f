"""Differences, merges, overlays and replays of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.functions.text import fingerprint


def revision_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of the rows that differ; keys are unique on each side. One full join on digests."""
    rest = [c for c in before.columns if c not in keys]
    digest = lambda df, name: df.select(*keys, fingerprint(*(F.col(c) for c in rest)).alias(name))
    both = digest(before, "_old").join(digest(after, "_new"), keys, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def overlay(authored: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """All authored rows, and the reference rows whose key isn't authored."""
    return authored.unionByName(reference.join(authored.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def restore(base: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """base without removed ids, changed rows in place of their old ones, new rows added."""
    gone = removed.select(key).union(changed.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(changed)


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """key, merged, outcome (same, ours, theirs, both, conflict): null-safe; a missing row is a null value."""
    sides = [df.select(key, F.col(value).alias(name)) for df, name in ((base, "_b"), (ours, "_o"), (theirs, "_t"))]
    rows = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    b, o, t = F.col("_b"), F.col("_o"), F.col("_t")
    same = lambda x, y: x.eqNullSafe(y)
    outcome = F.when(same(o, t), F.when(same(o, b), "same").otherwise("both")).when(same(o, b), "theirs").when(same(t, b), "ours").otherwise("conflict")
    merged = F.when(same(o, b), t).when(same(t, b) | same(o, t), o)
    return rows.select(key, merged.alias("merged"), outcome.alias("outcome"))


def replay(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, state: str = "state") -> DataFrame:
    """Each event with the state after it: open from an opening event to the next closing one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(opens, F.lit("open")).when(closes, F.lit("closed")), ignorenulls=True).over(w)
    return events.withColumn(state, F.coalesce(last, F.lit("new")))
