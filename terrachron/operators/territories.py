"""Territories as rings: overlaps and borders of all pairs, differences by component, adjustment of rival claims, edits of areas.

Shapes are rows (id, hole, ring), as many for an id as it has rings. What meets is found by boxes; each pair, component or
owner is an overlay of its own, and all of them run at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.geometry import bounds
from terrachron.operators import overlay as ov
from terrachron.operators.shapes import significant_area
from terrachron.operators.spatial import boxes_join
from terrachron.sources.shared import counted, settled

SHAPE = ["id", "hole", "ring"]


def _boxed(shapes: DataFrame, keys: list[str]) -> DataFrame:
    rings = shapes.where(F.size("ring") > 0).select(*keys, bounds(F.col("ring")).alias("b"))
    return rings.groupBy(*keys).agg(*((F.min if c in "ws" else F.max)(f"b.{c}").alias(c) for c in "wsen"))


def meeting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b): shapes (id, hole, ring) whose boxes share more than an edge."""
    return meeting_boxes(_boxed(a, ["id"]), _boxed(b, ["id"]), size)


def meeting_boxes(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b): boxes (id, w, s, e, n) that share more than an edge, by their sides as they are given."""
    strict = (F.col("aw") < F.col("be")) & (F.col("bw") < F.col("ae")) & (F.col("as") < F.col("bn")) & (F.col("bs") < F.col("an"))
    return boxes_join(a, b, size, sides_too=True).where(strict).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _problems(pairs: DataFrame, gid: Column, a: DataFrame, b: DataFrame) -> DataFrame:
    """The rings of both shapes of each pair (a, b), told apart by gid."""
    sides = [pairs.join(shapes.select(F.col("id").alias(s), "hole", "ring"), s).select(gid.alias("gid"), F.lit(s).alias("side"), "hole", "ring") for shapes, s in ((a, "a"), (b, "b"))]
    return sides[0].unionByName(sides[1])


def pair_areas(pairs: DataFrame, a: DataFrame, b: DataFrame, rules: list[str]) -> DataFrame:
    """Pairs (a, b) with the area under each rule; 0 where nothing is kept."""
    pieces = ov.overlay(_problems(pairs, F.struct("a", "b"), a, b), rules)
    found = ov.areas(pieces, ["gid", "rule"]).groupBy("gid").agg(*(F.sum(F.when(F.col("rule") == r, F.col("area"))).alias(r) for r in rules))
    found = found.select(F.col("gid.a").alias("a"), F.col("gid.b").alias("b"), *rules)
    return pairs.join(found, ["a", "b"], "left").select("a", "b", *(F.coalesce(r, F.lit(0.0)).alias(r) for r in rules))


def shape_areas(shapes: DataFrame) -> DataFrame:
    """(id, area) of shapes, what their rings cover counted once."""
    rings = shapes.select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    return ov.areas(ov.overlay(rings, "union"), ["gid"]).withColumnRenamed("gid", "id")


def overlapping(shapes: DataFrame, size: float) -> DataFrame:
    """(a, b, area): pairs of shapes, a < b, that share an area which counts beside either's own."""
    return overlapping_of(meeting(shapes, shapes, size).where("a < b"), shapes)


def overlapping_of(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of shapes that share an area which counts beside either's own, with that area."""
    pairs = settled(pairs.select("a", "b"))
    shared = pair_areas(pairs, shapes, shapes, ["intersection"])
    own = settled(shape_areas(shapes))
    rows = shared.join(own.select(F.col("id").alias("a"), F.col("area").alias("area_a")), "a").join(own.select(F.col("id").alias("b"), F.col("area").alias("area_b")), "b")
    area = F.col("intersection")
    return rows.where(significant_area(area, F.col("area_a")) & significant_area(area, F.col("area_b"))).select("a", "b", area.alias("area"))


def pair_borders(pairs: DataFrame, shapes: DataFrame, scale: int = ov.SCALE, shortest: float = 1e-9) -> DataFrame:
    """(a, b, line_no, length, points): what two shapes have as a common border, also where edges coincide in part only; joined into lines.

    A border has one of the shapes on either side; where both lie on the same side, they overlap there and it is none.
    """
    lines = ov.chains(ov.common(_problems(pairs, F.struct("a", "b"), shapes, shapes), scale), scale).where(F.col("length") > shortest)
    by = F.row_number().over(ov.Window.partitionBy("gid").orderBy("points"))
    return lines.select(F.col("gid.a").alias("a"), F.col("gid.b").alias("b"), by.alias("line_no"), "length", "points")


def rings_of(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons (keys, polygon_id, rings) as rings (keys, polygon_id, hole, ring)."""
    return polygons.select(*keys, "polygon_id", F.posexplode("rings").alias("i", "ring")).select(*keys, "polygon_id", (F.col("i") > 0).alias("hole"), "ring")


def component_difference(components: DataFrame, cutters: DataFrame, size: float) -> DataFrame:
    """(id, component, polygon_id, area, rings): what cutters (id, hole, ring) leave of each component (id, component, hole, ring).

    Each component is cut by itself, and only by cutters whose boxes share more than an edge with its own; one that meets none comes out as it is.
    """
    named = components.select(F.struct("id", "component").alias("id"), "hole", "ring")
    pairs = settled(meeting(named, cutters, size))
    cut = pairs.select("a").distinct()
    left = named.join(cut, named.id == cut.a, "left_semi").select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    right = pairs.join(cutters.select(F.col("id").alias("b"), "hole", "ring"), "b").select(F.col("a").alias("gid"), F.lit("b").alias("side"), "hole", "ring")
    whole = named.join(cut, named.id == cut.a, "left_anti").select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    pieces = ov.overlay(left.unionByName(right).unionByName(whole), "difference")
    return ov.polygons(pieces, ["gid"]).select("gid.id", "gid.component", "polygon_id", "area", "rings")


def _replaced(shapes: DataFrame, problems: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """Shapes with those of the problems (gid, side, hole, ring) put in place of the ids gid, and these ids: with an area left, or without."""
    ids = settled(problems.select(F.col("gid").alias("id")).distinct())
    made = settled(rings_of(ov.polygons(ov.overlay(problems, rule), ["gid"]), ["gid"]).select(F.col("gid").alias("id"), "hole", "ring"))
    kept = shapes.join(ids, "id", "left_anti").select(*SHAPE)
    left = ids.join(made.select("id").distinct().withColumn("_left", F.lit(True)), "id", "left").select("id", F.coalesce("_left", F.lit(False)).alias("left"))
    return settled(kept.unionByName(made)), left


def _sides(shapes: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Problems of links (id, other): the id's own rings as side a, the others' as side b."""
    own = shapes.join(links.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    others = links.join(sources.select(F.col("id").alias("other"), "hole", "ring"), "other").select(F.col("id").alias("gid"), F.lit("b").alias("side"), "hole", "ring")
    return own.unionByName(others)


def _waves(rules: list[tuple]) -> list[list[tuple]]:
    """Rules (target, priority) in order, cut wherever one needs the result of one before it."""
    waves: list[list[tuple]] = []
    for target, priority in sorted(set(rules)):
        if not waves or any(priority == t or target == p for t, p in waves[-1]):
            waves.append([])
        waves[-1].append((target, priority))
    return waves


def adjusted(rows: DataFrame, shapes: DataFrame, size: float, replacements: list[tuple] = ()) -> tuple[DataFrame, DataFrame]:
    """Rival claims settled without regard to any order of rows: (shapes that are left, log).

    rows (id, parent, snapshot) describe the shapes (id, hole, ring). First, of each replacement (target, priority), a short policy, the target gives way.
    Then, of rows with one parent (null counts as one) that aren't both snapshots and share an area that counts for both, each loses
    what its rivals had at first, so that what three claim is nobody's. After either step children of changed parents are cut
    to them, level by level; a child of a parent that has nothing left goes. log: (id, kind, related), related in order.
    """
    logs: list[DataFrame] = []
    ids = rows.select("id", "parent", F.coalesce("snapshot", F.lit(False)).alias("snapshot"))
    changed = None

    def note(left: DataFrame, links: DataFrame, kind: str) -> DataFrame:
        related = links.groupBy("id").agg(F.array_sort(F.collect_set(F.col("other").cast("string"))).alias("related"))
        logs.append(settled(left.join(related, "id").select("id", F.when(F.col("left"), kind).otherwise("empty-after-adjustment").alias("kind"), "related")))
        return left.select("id")

    def cut_children(shapes: DataFrame, parents: DataFrame) -> DataFrame:
        while True:
            below = ids.where(~F.col("snapshot")).join(parents.withColumnRenamed("id", "parent"), "parent").join(shapes.select("id").distinct(), "id", "left_semi").select("id", F.col("parent").alias("other"))
            links, n = counted(below)
            if not n:
                return shapes
            problems = _sides(shapes, links, shapes)
            pieces = ov.areas(ov.overlay(problems, ["difference"]), ["gid"]).select(F.col("gid").alias("id"), "area")
            own = shape_areas(shapes.join(links.select("id"), "id", "left_semi")).withColumnRenamed("area", "own")
            outside = settled(pieces.join(own, "id").where(significant_area(F.col("area"), F.col("own"))).select("id"))
            links, n = counted(links.join(outside, "id", "left_semi"))
            if not n:
                return shapes
            shapes, left = _replaced(shapes, _sides(shapes, links, shapes), "intersection")
            parents = note(left, links, "parent-clipping")

    shapes = settled(shapes.select(*SHAPE))
    for wave in _waves(list(replacements)):
        asked = shapes.sparkSession.createDataFrame(wave, f"id {dict(shapes.dtypes)['id']}, other {dict(shapes.dtypes)['id']}")
        met = pair_areas(asked.select(F.col("id").alias("a"), F.col("other").alias("b")), shapes, shapes, ["intersection"])
        met = met.join(shape_areas(shapes).select(F.col("id").alias("a"), "area"), "a").where(significant_area(F.col("intersection"), F.col("area")))
        links, n = counted(met.select(F.col("a").alias("id"), F.col("b").alias("other")))
        if n:
            shapes, left = _replaced(shapes, _sides(shapes, links, shapes), "difference")
            done = note(left, links, "explicit-replacement")
            changed = done if changed is None else settled(changed.union(done).distinct())
    if changed is not None:
        shapes = cut_children(shapes, changed)
    known = [ids.select(F.col("id").alias(s), F.col("parent").alias(f"parent_{s}"), F.col("snapshot").alias(f"snapshot_{s}")) for s in "ab"]
    # Who may be rivals is told before any shapes are overlaid.
    near = meeting(shapes, shapes, size).where("a < b").join(known[0], "a").join(known[1], "b")
    rivals = overlapping_of(near.where(F.col("parent_a").eqNullSafe(F.col("parent_b")) & ~(F.col("snapshot_a") & F.col("snapshot_b"))), shapes)
    links, n = counted(rivals.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("l")).select("l.id", "l.other"))
    if n:
        shapes, left = _replaced(shapes, _sides(shapes, links, shapes), "difference")
        shapes = cut_children(shapes, note(left, links, "unknown-peer-overlap"))
    empty = shapes.sparkSession.createDataFrame([], f"id {dict(shapes.dtypes)['id']}, kind string, related array<string>")
    for part in logs:
        empty = empty.unionByName(part)
    return shapes, empty


def merged(shapes: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, polygon_id, area, rings): the union of the shapes of each owner (id, owner); shapes without an owner are left out."""
    rings = shapes.join(owners, "id").select(F.col("owner").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    return ov.polygons(ov.overlay(rings, "union"), ["gid"]).withColumnRenamed("gid", "owner")


def annexed(shapes: DataFrame, areas: DataFrame, size: float, unclaimed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Areas (target, hole, ring) move to their targets from whoever holds them: (shapes afterwards, areas refused).

    Each target's areas are taken together. They must lie within the union of what other shapes hold, but for an area
    that doesn't count, unless `unclaimed` is allowed; else the target is refused and nothing of it moves. Areas of different targets must not overlap.
    """
    wanted = areas.select(F.col("target").alias("id"), "hole", "ring")
    pairs = settled(meeting(wanted, shapes, size).where("a <> b"))
    asked = settled(wanted)
    free = asked.select("id").distinct().withColumn("outside", F.lit(0.0))
    if not unclaimed:
        links = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"))
        mine = asked.select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
        held = _sides(asked.limit(0), links, shapes).where("side = 'b'").unionByName(mine)
        over = ov.areas(ov.overlay(held, "difference"), ["gid"]).select(F.col("gid").alias("id"), F.col("area").alias("outside"))
        free = free.select("id").join(over, "id", "left").select("id", F.coalesce("outside", F.lit(0.0)).alias("outside"))
    free = settled(free.join(shape_areas(asked).withColumnRenamed("area", "asked"), "id"))
    refused = free.where(significant_area(F.col("outside"), F.col("asked"))).select("id", "outside", "asked")
    allowed = settled(free.join(refused, "id", "left_anti").select("id"))
    moving = settled(asked.join(allowed, "id", "left_semi"))
    donors = settled(pairs.join(allowed.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"), F.col("a").alias("other")))
    after, _ = _replaced(shapes, _sides(shapes, donors, moving), "difference")
    gain = after.join(allowed, "id", "left_semi").unionByName(moving).select(F.col("id").alias("gid"), F.lit("a").alias("side"), "hole", "ring")
    after, _ = _replaced(after, gain, "union")
    return after, refused


def without_slivers(polygons: DataFrame, keys: list[str], piece: float, total: float) -> DataFrame:
    """Polygons (keys, polygon_id, area, ...) without those of at most `piece`, the least ones first, as long as those of a key come to `total` at most."""
    w = ov.Window.partitionBy(*keys).orderBy("area", "polygon_id")
    small = F.col("area") <= piece
    gone = F.coalesce(F.sum(F.when(small, F.col("area"))).over(w), F.lit(0.0))
    return polygons.withColumn("_gone", gone).where(~(small & (F.col("_gone") <= total))).drop("_gone")
