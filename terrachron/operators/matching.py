"""Matches between two tables: nearest lines, winners by a margin, merge plans, references, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.operators import ranges
from terrachron.sources.shared import settled, spread


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance from a point to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def near_segments(points: DataFrame, segments: DataFrame, most: float) -> DataFrame:
    """(id, segment, distance, cos) for points (id, x, y) and segments (id, x1, y1, x2, y2) within `most`.

    A segment is indexed by pieces no longer than `most`, so it takes cells in proportion to its length and not to its
    box. A pair that meets in several pieces comes once. With dx, dy in points, cos is the alignment, without sign.
    """
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / most).cast("int"))
    pieces = segments.select(F.col("id").alias("segment"), "x1", "y1", "x2", "y2", n.alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def cells(low: str, high: str) -> Column:
        a, b = F.col(low), F.col(high)
        p, q = a + (b - a) * F.col("_i") / F.col("_n"), a + (b - a) * (F.col("_i") + 1) / F.col("_n")
        return F.sequence(F.floor(F.least(p, q) / most - 1e-9) - 1, F.floor(F.greatest(p, q) / most + 1e-9) + 1)

    indexed = pieces.withColumn("_cx", F.explode(cells("x1", "x2"))).withColumn("_cy", F.explode(cells("y1", "y2"))).drop("_i", "_n").distinct()
    home = points.withColumn("_cx", F.floor(F.col("x") / most)).withColumn("_cy", F.floor(F.col("y") / most))
    d = segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    found = home.join(indexed, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= most)
    if "dx" not in points.columns:
        return found.select("id", "segment", "distance")
    sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cos = F.abs(F.col("dx") * sx + F.col("dy") * sy) / F.nullif(F.hypot("dx", "dy") * F.hypot(sx, sy), F.lit(0.0))
    return found.select("id", "segment", "distance", F.coalesce(cos, F.lit(0.0)).alias("cos"))


def nearest_segment(points: DataFrame, segments: DataFrame, most: float, least_cos: float | None = None) -> DataFrame:
    """(id, segment, distance): each point's nearest segment within `most`, the least id on ties; aligned by `least_cos` if given."""
    found = near_segments(points, segments, most)
    if least_cos is not None:
        found = found.where(F.col("cos") >= least_cos)
    return found.groupBy("id").agg(F.min(F.struct("distance", "segment")).alias("m")).select("id", "m.segment", "m.distance")


def box_iou(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """Common area of two boxes by that of both together; 0 for boxes without area."""
    common = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(w1, w2)) * F.greatest(F.lit(0.0), F.least(n1, n2) - F.greatest(s1, s2))
    return F.coalesce(common / F.nullif((e1 - w1) * (n1 - s1) + (e2 - w2) * (n2 - s2) - common, F.lit(0.0)), F.lit(0.0))


def clear_winners(pairs: DataFrame, a: str, b: str, score: str, margin: float) -> DataFrame:
    """The best b of each a, where the next best is at least `margin` behind or missing.

    A pair (a, b) that comes twice counts once, with its best score. An a's best is an aggregate, and the best of its other rows
    another one over the same rows, written once: what a task holds are groups, never an a's sorted pairs.
    """
    rows = settled(pairs.select(a, b, score))
    best = settled(rows.groupBy(a).agg(F.max(F.struct(score, b)).alias("_m")))
    # One row for an a is hashed, so its pairs aren't sorted either.
    others = rows.join(best.select(F.col(a).alias("_a"), F.col(f"_m.{b}").alias("_b")).hint("shuffle_hash"), F.col(a).eqNullSafe(F.col("_a"))).where(~F.col(b).eqNullSafe(F.col("_b")))
    second = others.groupBy(F.col("_a")).agg(F.max(score).alias("_next"))
    found = best.join(spread(second), F.col(a).eqNullSafe(F.col("_a")), "left")
    return found.where(F.col("_next").isNull() | (F.col(f"_m.{score}") - F.col("_next") >= margin)).select(a, f"_m.{b}", f"_m.{score}")


def merge_plan(incoming: DataFrame, current: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, action, ordinal): insert, update or keep. Of repeated current keys the last ordinal counts; repeated incoming keys are `invalid`."""
    new = incoming.groupBy(key).agg(F.count("*").alias("_n"))
    old = current.groupBy(key).agg(F.max(ordinal).alias(ordinal))
    action = F.when(F.col("_n") > 1, "invalid").when(F.col("_n").isNull(), "keep").when(F.col(ordinal).isNull(), "insert").otherwise("update")
    return new.join(old, key, "full_outer").select(key, action.alias("action"), ordinal)


def users(bindings: DataFrame, reference: list[str], owner: str) -> DataFrame:
    """The owners of each reference as rows, each once."""
    return bindings.select(*reference, owner).distinct()


def missing_references(active: DataFrame, loaded: DataFrame, reference: list[str]) -> DataFrame:
    """References of active rows that aren't loaded, each once; rows without a reference miss nothing."""
    asked = active.select(*reference).dropna().distinct()
    return asked.join(loaded.select(*reference), reference, "left_anti")


def whole_fragments(rows: DataFrame, key: str, index: str, total: str, lines: str) -> DataFrame:
    """(key, lines): fragments joined in order of their index, where all of 0 to total - 1 are there once and agree on the total."""
    parts = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(lines).alias("l")))).alias("p"), F.min(total).alias("t0"), F.max(total).alias("t1"),
        F.count_distinct(index).alias("d"), F.count("*").alias("n"), F.min(index).alias("i0"), F.max(index).alias("i1"),
    )
    whole = (F.col("t0") == F.col("t1")) & (F.col("n") == F.col("t0")) & (F.col("d") == F.col("n")) & (F.col("i0") == 0) & (F.col("i1") == F.col("n") - 1)
    return parts.where(whole).select(key, F.flatten(F.transform("p", lambda x: x["l"])).alias(lines))


def combined_rows(sources: list[tuple[DataFrame, int]], key: str, order: list[str], limit: int) -> DataFrame:
    """The first rows of each source, one for each key: at the place of its first row, with the values of its last.

    sources: (rows, how many of them); both limits are the feature, a report of its top rows.
    """
    parts = []
    for rank, (rows, most) in enumerate(sources):
        w = Window.orderBy(*order)  # over at most `most` rows
        top = rows.orderBy(*order).limit(most)
        parts.append(top.select(F.struct(F.lit(rank).alias("source"), F.row_number().over(w).alias("place")).alias("_at"), F.struct("*").alias("_row")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy(F.col(f"_row.{key}").alias("_key")).agg(F.min("_at").alias("_first"), F.max_by("_row", "_at").alias("_last"))
    return one.orderBy("_first").limit(limit).select("_last.*", F.col("_first.source").alias("source"))


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """rows with `batch`, from 1, of at most `size` rows for each group."""
    placed = ranges.running(rows, keys, order, F.lit(1).cast("long"), "_at")
    return placed.withColumn("batch", (F.floor(F.col("_at") / size) + 1).cast("int")).drop("_at")
