"""Polygon overlay as tables: edges split where they meet, labelled by winding, kept by a rule and walked into rings.

Many overlays run at once, told apart by a column `gid`; nothing depends on one overlay fitting into one task. Coordinates are
whole numbers of a grid, so which side of an edge a point lies on is decided exactly in 64 bits. Crossings are rounded to
the grid; as that bends edges, splitting is repeated until no edge has another one's end, or a crossing, inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.functions.geometry import signed_area
from terrachron.operators import cells, few
from terrachron.operators.few import ENDS, orient as _orient
from terrachron.operators.walks import in_order, walks
from terrachron.sources.shared import counted, settled

#: Grid steps of a unit. Coordinates may reach 500 units either way: then no product of differences leaves 64 bits.
SCALE = 1_000_000
#: Rounds of splitting; each but the last finds something to split, and two are the rule.
ROUNDS = 24
#: Level 0 of the cells that edges meet in, in grid steps.
CELL = 1 << 10

RULES = {
    "union": lambda a, b: (a != 0) | (b != 0),
    "intersection": lambda a, b: (a != 0) & (b != 0),
    "difference": lambda a, b: (a != 0) & (b == 0),
    "xor": lambda a, b: (a != 0) != (b != 0),
}


def ring_edges(rings: DataFrame, scale: int = SCALE, added_up: bool = True) -> DataFrame:
    """Net edges (gid, x1, y1, x2, y2, a, b) of rings (gid, side: a or b, hole, ring), least end first.

    a and b say how often an edge is run through forwards, less backwards, by rings of either side: outer rings count anticlockwise, holes
    clockwise, whatever their sense. Rings of a side may overlap. Rings that are null or not closed are closed; edges without length, and
    those that cancel, are left out. Not added up, an edge has a row for each time that it is run through.
    """
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.size("ring") - 1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("ring")).otherwise(F.concat("ring", F.array(first)))
    rows = rings.where(F.size("ring") > 1).select("gid", "side", F.col("hole"), closed.alias("ring"))
    turn = F.when((signed_area(F.col("ring")) < 0) == F.coalesce(F.col("hole"), F.lit(False)), 1).otherwise(-1)
    at = lambda p, c: F.round(p[c] * scale).cast("long")
    whole = F.transform("ring", lambda p: F.struct(at(p, "x").alias("x"), at(p, "y").alias("y")))
    rows = rows.select("gid", "side", turn.alias("turn"), whole.alias("p"))
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("p"), F.get("p", i).alias("q")))
    e = rows.select("gid", "side", "turn", F.explode(steps).alias("e")).select("gid", "side", "turn", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "pq" for c in "xy")).dropna()
    forward = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    e = e.where((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy")))
    e = e.select("gid", "side", pick("px", "qx").alias("x1"), pick("py", "qy").alias("y1"), pick("qx", "px").alias("x2"), pick("qy", "py").alias("y2"), F.when(forward, F.col("turn")).otherwise(-F.col("turn")).alias("d"))
    e = e.select("gid", *ENDS, *(F.when(F.col("side") == s, F.col("d")).otherwise(0).cast("long").alias(s) for s in "ab"))
    return net(e) if added_up else e


def net(edges: DataFrame) -> DataFrame:
    """Equal edges added up; those that cancel go."""
    return edges.groupBy("gid", *ENDS).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 0 or b <> 0")


def _cuts(edges: DataFrame, cell: int) -> DataFrame:
    """(gid, x1, y1, x2, y2, px, py): points inside of edges at which others touch or cross them."""
    extent = F.greatest(F.col("x2") - F.col("x1"), F.abs(F.col("y2") - F.col("y1")))
    rows = edges.select("gid", *ENDS, cells.level_of(extent, cell).alias("level"))
    low = [F.col("x1"), F.least("y1", "y2")]
    high = [F.col("x2"), F.greatest("y1", "y2")]
    mine = cells.own_cells(rows, cell, low, high)
    finer = cells.coarser_cells(rows, cells.occurring(rows.select("level")), cell, low, high)
    named = lambda df, s: df.select("gid", "_level", "_c0", "_c1", F.col("level").alias(f"{s}l"), *(F.col(c).alias(f"{s}{c}") for c in ENDS))
    pair = named(mine, "e").join(named(mine.unionByName(finer), "f"), ["gid", "_level", "_c0", "_c1"])
    e, f = ({c: F.col(f"{s}{c}") for c in ENDS} for s in "ef")
    lows = {s: (F.col(f"{s}x1"), F.least(f"{s}y1", f"{s}y2")) for s in "ef"}
    highs = {s: (F.col(f"{s}x2"), F.greatest(f"{s}y1", f"{s}y2")) for s in "ef"}
    once = (F.col("fl") < F.col("el")) | (F.struct(*e.values()) < F.struct(*f.values()))
    meet = (lows["e"][0] <= highs["f"][0]) & (lows["f"][0] <= highs["e"][0]) & (lows["e"][1] <= highs["f"][1]) & (lows["f"][1] <= highs["e"][1])
    here = cells.first_shared(cell, 0, lows["e"][0], lows["f"][0]) & cells.first_shared(cell, 1, lows["e"][1], lows["f"][1])
    pair = pair.where(once & meet & here)
    line = lambda s: [s["x1"], s["y1"], s["x2"], s["y2"]]
    pair = pair.select(
        "gid", *e.values(), *f.values(),
        _orient(*line(e), f["x1"], f["y1"]).alias("o1"), _orient(*line(e), f["x2"], f["y2"]).alias("o2"),
        _orient(*line(f), e["x1"], e["y1"]).alias("o3"), _orient(*line(f), e["x2"], e["y2"]).alias("o4"),
    )
    crossing = (F.signum("o1") * F.signum("o2") < 0) & (F.signum("o3") * F.signum("o4") < 0)
    t = F.col("o3").cast("double") / (F.col("o3").cast("double") - F.col("o4").cast("double"))
    point = lambda x, y, on: F.struct(x.alias("x"), y.alias("y"), on.alias("on"))
    meeting = point(F.round(e["x1"] + t * (e["x2"] - e["x1"])).cast("long"), F.round(e["y1"] + t * (e["y2"] - e["y1"])).cast("long"), crossing)
    meeting = F.when(crossing, meeting)
    on = lambda o, s, i: point(s[f"x{i}"], s[f"y{i}"], F.col(o) == 0)
    cut_of = lambda s, points: F.struct(*(s[c].alias(c) for c in ENDS), F.array(*points).alias("p"))
    both = F.array(cut_of(e, [on("o1", f, 1), on("o2", f, 2), meeting]), cut_of(f, [on("o3", e, 1), on("o4", e, 2), meeting]))
    cut = pair.where((F.signum("o1") * F.signum("o2") <= 0) & (F.signum("o3") * F.signum("o4") <= 0)).select("gid", F.explode(both).alias("c"))
    cut = cut.select("gid", *(F.col(f"c.{c}").alias(c) for c in ENDS), F.explode("c.p").alias("p")).where("p.on").select("gid", *ENDS, F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    at_end = ((F.col("px") == F.col("x1")) & (F.col("py") == F.col("y1"))) | ((F.col("px") == F.col("x2")) & (F.col("py") == F.col("y2")))
    return cut.where(inside & ~at_end).distinct()


def _split(rows: DataFrame, cuts: DataFrame, keys: list[str], signs: list[str]) -> DataFrame:
    """Rows (gid, x1, y1, x2, y2, keys, signs) cut at the points inside of their edges. Signs belong to an edge's way: they change where its ends change places."""
    at = ["gid", *ENDS]
    cut_edges = cuts.select(*at).distinct()
    some = rows.join(cut_edges, at, "left_semi")
    both = F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")))
    points = some.withColumn("p", F.explode(both)).select(*at, *keys, *signs, "p.px", "p.py").unionByName(some.join(cuts, at).select(*at, *keys, *signs, "px", "py"))
    # Along an edge x never falls, and y goes one way.
    w = Window.partitionBy(*at, *keys).orderBy("px", F.when(F.col("y2") < F.col("y1"), -F.col("py")).otherwise(F.col("py")))
    nxt = points.withColumns({"qx": F.lead("px").over(w), "qy": F.lead("py").over(w)}).where("qx is not null")
    # Rounding may turn a short, steep piece round: its ends are put in order again.
    back = (F.col("qx") < F.col("px")) | ((F.col("qx") == F.col("px")) & (F.col("qy") < F.col("py")))
    pick = lambda x, y: F.when(back, F.col(y)).otherwise(F.col(x))
    pieces = nxt.select("gid", pick("px", "qx").alias("x1"), pick("py", "qy").alias("y1"), pick("qx", "px").alias("x2"), pick("qy", "py").alias("y2"), *keys, *(F.when(back, -F.col(s)).otherwise(F.col(s)).alias(s) for s in signs))
    return rows.join(cut_edges, at, "left_anti").select(*at, *keys, *signs).unionByName(pieces)


def arranged(edges: DataFrame, cell: int = CELL) -> DataFrame:
    """Net edges split until they meet at their ends only."""
    now = settled(edges)
    for _ in range(ROUNDS):
        cuts, n = counted(_cuts(now, cell))
        if not n:
            return now
        now = settled(net(_split(now, cuts, [], ["a", "b"])))
    raise RuntimeError("edges did not settle on the grid")


def pieces_of(edges: DataFrame, cell: int = CELL) -> DataFrame:
    """Distinct edges (gid, x1, y1, x2, y2) split until they meet at their ends only, each piece with the edge that it comes from: of_x1 to of_y2; way is -1 where it runs the other way."""
    of = [f"of_{c}" for c in ENDS]
    now = settled(edges.select("gid", *ENDS).distinct().select("*", *(F.col(c).alias(o) for c, o in zip(ENDS, of, strict=True)), F.lit(1).cast("long").alias("way")))
    for _ in range(ROUNDS):
        cuts, n = counted(_cuts(now.select("gid", *ENDS).distinct(), cell))
        if not n:
            return now
        now = settled(_split(now, cuts, of, ["way"]))
    raise RuntimeError("edges did not settle on the grid")


def labelled(pieces: DataFrame, cell: int = CELL) -> DataFrame:
    """Pieces with ra, rb: how often either side winds round what lies to the right of a piece (below it, or east of an upright one).

    A ray goes down from the middle of each piece and adds up what it meets. Pieces are known by the cells of their width, so a ray meets
    only those above or below it; each piece counts where the ray's place lies in its half-open span.
    """
    rows = pieces.withColumn("level", cells.level_of(F.col("x2") - F.col("x1"), cell))
    spans = rows.where("x1 < x2")
    met = cells.own_cells(spans, cell, [F.col("x1")], [F.col("x2")]).select("gid", "_level", "_c0", *(F.col(c).alias(f"f{c}") for c in (*ENDS, "a", "b")))
    levels = cells.occurring(spans.select("level"))
    rays = pieces.select("gid", *ENDS, "a", "b", (F.col("x1") + F.col("x2")).alias("mx"), (F.col("y1") + F.col("y2")).alias("my"), F.lit(-1).alias("level"))
    rays = cells.coarser_cells(rays, levels, cell, [F.col("mx") / 2], [F.col("mx") / 2])
    hit = rays.join(met, ["gid", "_level", "_c0"])
    # Twice the place of the middle, so that it is a whole number.
    above = _orient(2 * F.col("fx1"), 2 * F.col("fy1"), 2 * F.col("fx2"), 2 * F.col("fy2"), F.col("mx"), F.col("my")) > 0
    hit = hit.where((2 * F.col("fx1") <= F.col("mx")) & (F.col("mx") < 2 * F.col("fx2")) & (2 * F.least("fy1", "fy2") <= F.col("my")) & above)
    zero = F.lit(0).cast("long")
    keys = ["gid", *ENDS, "a", "b"]
    every = hit.select(*keys, F.col("fa").alias("ra"), F.col("fb").alias("rb")).unionByName(pieces.select(*keys, zero.alias("ra"), zero.alias("rb")))
    return every.groupBy(*keys).agg(F.sum("ra").alias("ra"), F.sum("rb").alias("rb"))


def _bounds(rules: list[str]) -> Column:
    """What a labelled piece bounds under each rule, as structs (rule, x1, y1, x2, y2) with what is kept to their left; null where nothing."""
    def of(rule: str) -> Column:
        left, right = RULES[rule](F.col("ra") + F.col("a"), F.col("rb") + F.col("b")), RULES[rule](F.col("ra"), F.col("rb"))
        pick = lambda x, y: F.when(left, F.col(x)).otherwise(F.col(y))
        return F.when(left != right, F.struct(F.lit(rule).alias("rule"), pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2")))

    return F.array(*(of(rule) for rule in rules))


def bounded_by(labels: DataFrame, rules: list[str]) -> DataFrame:
    """(gid, rule, x1, y1, x2, y2): the pieces that bound what a rule keeps, which lies to their left."""
    return labels.select("gid", F.explode(F.array_compact(_bounds(rules))).alias("o")).select("gid", "o.*")


def overlay(rings: DataFrame, rules: list[str] | str, scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """Bounding pieces (gid, rule, x1, y1, x2, y2; on the grid) of rings (gid, side, hole, ring) under one or more rules."""
    rules = [rules] if isinstance(rules, str) else rules
    return _kept(rings, lambda: _bounds(rules), lambda pieces: bounded_by(labelled(pieces, cell), rules), True, scale, cell)


def common(rings: DataFrame, scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """Pieces (gid, x1, y1, x2, y2) that both sides of rings (gid, side, hole, ring) run along, one on either side of them."""
    kept = lambda: F.array(F.when(F.signum("a") * F.signum("b") < 0, F.struct(F.lit("common").alias("rule"), *ENDS)))
    general = lambda pieces: pieces.select("gid", F.explode(F.array_compact(kept())).alias("o")).select("gid", "o.*")
    return _kept(rings, kept, general, False, scale, cell).select("gid", *ENDS)


def _kept(rings: DataFrame, kept, general, wound: bool, scale: int, cell: int) -> DataFrame:
    """(gid, rule, x1, y1, x2, y2) of rings: overlays of few edges by `kept` (as few.cut_and_kept takes it), the arranged pieces of others by `general`."""
    rings, n = counted(rings)
    small, large = few.parted(rings, ["gid"], F.coalesce(F.size("ring"), F.lit(0)), few.CORNERS)
    columns = ["gid", "rule", *ENDS]
    edges = ring_edges(few.dealt_by(small, n, ["gid"]), scale, added_up=False)
    rest = None if large is None else ring_edges(large, scale)
    out = None
    for _ in range(ROUNDS):
        found, left = counted(few.cut_and_kept(edges, kept, wound), F.col("again") > 0)
        done = found.where("again = 0").select(*columns)
        out = done if out is None else out.unionByName(done)
        if not left:
            break
        # Rounded crossings bend edges: only overlays that have some are cut again.
        more = found.where("again = 2").select("gid", *ENDS, "a", "b")
        rest = more if rest is None else rest.unionByName(more)
        edges = few.dealt_by(found.where("again = 1").select("gid", *ENDS, "a", "b"), left, ["gid"])
    else:
        raise RuntimeError("edges did not settle on the grid")
    if rest is None:
        return out
    rest, n = counted(rest)
    return out.unionByName(settled(general(arranged(rest, cell)).select(*columns))) if n else out


def areas(pieces: DataFrame, keys: list[str], scale: int = SCALE) -> DataFrame:
    """(keys, area): what pieces bound on their left, exact on the grid; what has no pieces has no row."""
    cross = F.col("x1").cast("decimal(20,0)") * F.col("y2") - F.col("x2").cast("decimal(20,0)") * F.col("y1")
    return pieces.groupBy(*keys).agg((F.sum(cross.cast("decimal(28,0)")).cast("double") / (2.0 * scale * scale)).alias("area"))


def turns(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, next) of directed edges (keys, id, x1, y1, x2, y2): at an edge's end the next one clockwise from the way back.

    Edges with their area to the left are so walked around that area. Directions are compared exactly, by quadrant and quotient.
    """
    return _following(edges, keys).select("id", "next")


def _following(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, id, x1, y1, x2, y2) with the next one."""
    spoke = lambda x, y, u, v, out: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(u) - F.col(x)).alias("dx"), (F.col(v) - F.col(y)).alias("dy"), F.lit(out).alias("out"))
    both = F.explode(F.array(spoke("x1", "y1", "x2", "y2", True), spoke("x2", "y2", "x1", "y1", False)))
    spokes = edges.select(*keys, "id", *ENDS, both.alias("s")).select(*keys, "id", *ENDS, "s.*")
    dx, dy = F.col("dx"), F.col("dy")
    quadrant = F.when((dx > 0) & (dy >= 0), 0).when((dx <= 0) & (dy > 0), 1).when((dx < 0) & (dy <= 0), 2).otherwise(3)
    over, under = F.when(quadrant % 2 == 0, F.abs(dy)).otherwise(F.abs(dx)), F.when(quadrant % 2 == 0, F.abs(dx)).otherwise(F.abs(dy))
    whole = F.floor(over / under).cast("decimal(20,0)")
    whole = F.when(whole * under > over, whole - 1).when((whole + 1) * under <= over, whole + 1).otherwise(whole)
    rest = (over - whole * under).cast("decimal(11,0)") * F.lit(10**18).cast("decimal(19,0)") / under.cast("decimal(11,0)")
    node = Window.partitionBy(*keys, "x", "y").orderBy("quadrant", "whole", "rest", "out")
    spokes = spokes.withColumns({"quadrant": quadrant, "whole": whole, "rest": rest})
    leaving = F.last(F.when(F.col("out"), F.col("id")), ignorenulls=True)
    before, round_ = leaving.over(node.rowsBetween(Window.unboundedPreceding, -1)), leaving.over(node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return spokes.withColumn("next", F.coalesce(before, round_)).where("not out").select(*keys, "id", *ENDS, "next")


def walked(edges: DataFrame, keys: list[str], scale: int = SCALE) -> DataFrame:
    """Rings (keys, ring_id, n, area, ring) of directed edges (keys, x1, y1, x2, y2), each with its area to the left.

    A ring is closed and begins where its least edge does; its area is positive, a hole's negative. ring_id is a number of this run only.
    """
    small, large = _few_rings(edges, keys, scale)
    if large is None:
        return small
    large = settled(large.withColumn("id", -1 - F.monotonically_increasing_id()))
    return small.unionByName(_rings(large.join(walks(turns(large, keys)).withColumnRenamed("head", "ring_id"), "id"), keys, scale))


def _few_rings(edges: DataFrame, keys: list[str], scale: int) -> tuple[DataFrame, DataFrame | None]:
    """The rings of keys with few edges, ring_id from 0, and the edges of the other keys, if there are some."""
    edges, n = counted(edges.select(*keys, *ENDS))
    small, large = few.parted(edges, keys, F.lit(1), few.PIECES)
    numbered = few.dealt_by(small, n, keys).withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(*ENDS)) - 1)
    found = _rings(few.rings_within(_following(numbered, keys), keys), keys, scale)
    return settled(found.withColumn("ring_id", F.monotonically_increasing_id())), large


def _rings(rows: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """Rings of edges with their places (keys, x1, y1, x2, y2, ring_id, offset)."""
    corner = F.struct((F.col("x1") / scale).alias("x"), (F.col("y1") / scale).alias("y"))
    cross = (F.col("x1").cast("decimal(20,0)") * F.col("y2") - F.col("x2").cast("decimal(20,0)") * F.col("y1")).cast("decimal(28,0)")
    found = rows.groupBy(*keys, "ring_id").agg(F.count("*").alias("n"), (F.sum(cross).cast("double") / (2.0 * scale * scale)).alias("area"), F.sort_array(F.collect_list(F.struct((-F.when(F.col("offset") == 0, F.lit(1 << 62)).otherwise(F.col("offset"))).alias("o"), corner.alias("p")))).alias("s"))
    points = F.transform("s", lambda s: s["p"])
    return found.select(*keys, "ring_id", "n", "area", F.concat(points, F.slice(points, 1, 1)).alias("ring"))


def faces(pieces: DataFrame, scale: int = SCALE) -> DataFrame:
    """(gid, ring_id, n, area, ring): the faces of planar pieces (gid, x1, y1, x2, y2), walked with the face to the left; each connected part has one outer ring, of negative (or no) area."""
    both = pieces.select("gid", *ENDS).unionByName(pieces.select("gid", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    return walked(both, ["gid"], scale)


def without_straight(ring: Column, tolerance: float = 0.0) -> Column:
    """A closed ring without the corners that lie on the way between their neighbours."""
    n = F.size(ring) - 1
    corner = lambda i: F.get(ring, F.pmod(i, n))
    bent = lambda i: F.abs((corner(i)["x"] - corner(i - 1)["x"]) * (corner(i + 1)["y"] - corner(i - 1)["y"]) - (corner(i)["y"] - corner(i - 1)["y"]) * (corner(i + 1)["x"] - corner(i - 1)["x"])) > tolerance
    kept = F.transform(F.filter(F.sequence(F.lit(0), n - 1), bent), corner)
    return F.concat(kept, F.slice(kept, 1, 1))


def polygons(pieces: DataFrame, keys: list[str], scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """Bounding pieces as polygons (keys, polygon_id, area, rings): an outer ring, and the holes that lie in it, by their least corner."""
    small, large = _few_rings(pieces, keys, scale)
    with_holes, n = counted(small.where("area < 0").select(*keys).distinct())
    plain = small.join(with_holes, keys, "left_anti") if n else small
    plain = plain.select(*keys, F.col("ring_id").alias("polygon_id"), "area", F.array("ring").alias("rings"))
    if n:
        more = pieces.select(*keys, *ENDS).join(with_holes, keys, "left_semi")
        large = more if large is None else large.unionByName(more)
    return plain if large is None else plain.unionByName(_nested(large, keys, scale, cell))


def _nested(pieces: DataFrame, keys: list[str], scale: int, cell: int) -> DataFrame:
    """Polygons of pieces whose rings may lie in each other. polygon_id is negative.

    A hole looks down from its least corner: what it meets first is its polygon's outer ring, or another hole of the same polygon.
    """
    edges = settled(pieces.select(*keys, *ENDS).withColumn("id", -1 - F.monotonically_increasing_id()))
    place = walks(turns(edges, keys)).select("id", F.col("head").alias("ring_id"), "offset")
    found, holes = counted(_rings(edges.join(place, "id"), keys, scale), F.col("area") < 0)
    if not holes:
        return found.select(*keys, F.col("ring_id").alias("polygon_id"), "area", F.array("ring").alias("rings"))
    # Of each hole: its least corner, and the lower one of the two edges there.
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    of = edges.join(place.drop("offset"), "id").join(found.where("area < 0").select("ring_id"), "ring_id")
    corners = of.groupBy(*keys, "ring_id").agg(F.min(F.least(at("x1", "y1"), at("x2", "y2"))).alias("v"))
    slope = lambda x1, y1, x2, y2: (F.col(y2) - F.col(y1)) / (F.col(x2) - F.col(x1))
    lower = of.join(corners.select("ring_id", "v"), "ring_id").where((at("x1", "y1") == F.col("v")) | (at("x2", "y2") == F.col("v")))
    lower = lower.groupBy(*keys, "ring_id").agg(F.first("v").alias("v"), F.min(F.when(F.col("x1") == F.col("x2"), float("inf")).otherwise(slope(*ENDS))).alias("own"))
    spans = edges.join(place.drop("offset"), "id").where("x1 <> x2").select(*keys, F.col("ring_id").alias("below"), F.least(at("x1", "y1"), at("x2", "y2")).alias("l"), F.greatest(at("x1", "y1"), at("x2", "y2")).alias("r"))
    spans = spans.withColumn("level", cells.level_of(F.col("r.x") - F.col("l.x"), cell))
    rays = lower.withColumn("level", F.lit(-1))
    rays = cells.coarser_cells(rays, cells.occurring(spans.select("level")), cell, [F.col("v.x").cast("double")], [F.col("v.x").cast("double")])
    hit = rays.drop("level").join(cells.own_cells(spans, cell, [F.col("l.x")], [F.col("r.x")]).drop("level"), [*keys, "_level", "_c0"]).where((F.col("l.x") <= F.col("v.x")) & (F.col("v.x") < F.col("r.x")))
    rise = (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
    side = _orient(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"), F.col("v.x"), F.col("v.y"))
    hit = hit.where((side > 0) | ((side == 0) & (F.col("l") == F.col("v")) & (rise < F.col("own")) & (F.col("below") != F.col("ring_id"))))
    first = hit.groupBy("ring_id").agg(F.max_by("below", F.struct((F.col("l.y") + (F.col("v.x") - F.col("l.x")) * rise).alias("y"), rise.alias("s"))).alias("next"))
    # From hole to hole until an outer ring: the same walk as around rings.
    chain = found.select(F.col("ring_id").alias("id"), "area").join(first.withColumnRenamed("ring_id", "id"), "id", "left").select("id", F.when(F.col("area") < 0, F.col("next")).alias("next"))
    outer = _upwards(chain)
    rows = found.join(outer, found.ring_id == outer.id).select(*keys, F.col("top").alias("polygon_id"), "area", "ring")
    rings = F.transform(F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), F.get("ring", F.lit(0)).alias("at"), "ring"))), lambda r: r["ring"])
    return rows.groupBy(*keys, "polygon_id").agg(F.sum("area").alias("area"), rings.alias("rings"))


def _upwards(chain: DataFrame) -> DataFrame:
    """(id, top): where links (id, next) end; several may lead to one."""
    now = settled(chain)
    while True:
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("next2"))
        joined = now.where("next is not null").join(ahead, "next").select("id", F.coalesce("next2", "next").alias("next"), F.col("next2").isNotNull().alias("moved"))
        nxt, moved = counted(joined, F.col("moved"))
        if not moved:
            return nxt.select("id", F.col("next").alias("top")).unionByName(now.where("next is null").select("id", F.col("id").alias("top")))
        now = settled(nxt.select("id", "next").unionByName(now.where("next is null").select("id", "next")))


def _through(edges: DataFrame) -> DataFrame:
    """Different edges (gid, x1, y1, x2, y2), and at which ends exactly one other edge follows: through1, through2."""
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(True).alias("first")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(False).alias("first"))))
    spokes = edges.select("gid", *ENDS).distinct().select("*", ends.alias("s")).select("gid", *ENDS, "s.*")
    spokes = spokes.withColumn("two", F.count("*").over(Window.partitionBy("gid", "x", "y")) == 2)
    return spokes.groupBy("gid", *ENDS).agg(F.max(F.col("first") & F.col("two")).alias("through1"), F.max(~F.col("first") & F.col("two")).alias("through2"))


def chains(edges: DataFrame, scale: int = SCALE) -> DataFrame:
    """Lines (gid, line_id, n, closed, length, points) of undirected edges (gid, x1, y1, x2, y2): they end where other than two edges meet.

    A line is given once, from the lesser of its ends; a loop begins at its least corner, towards the lesser neighbour. Equal edges count once.
    """
    edges, n = counted(edges.select("gid", *ENDS))
    small, large = few.parted(edges, ["gid"], F.lit(1), few.PIECES)
    found = _through(few.dealt_by(small, n, ["gid"]))
    found, n = counted(found if large is None else found.unionByName(_through(large)), F.col("through1") | F.col("through2"))
    # An edge that nothing follows at either end is a line.
    corner = lambda x, y: F.struct((F.col(x) / scale).alias("x"), (F.col(y) / scale).alias("y"))
    ends = F.when(F.struct("x1", "y1") < F.struct("x2", "y2"), F.array(corner("x1", "y1"), corner("x2", "y2"))).otherwise(F.array(corner("x2", "y2"), corner("x1", "y1")))
    alone = found.where("not through1 and not through2").select(
        "gid", (-1 - F.monotonically_increasing_id()).alias("line_id"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("closed"), (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / scale).alias("length"), ends.alias("points")
    )
    return alone.unionByName(_longer(found.where("through1 or through2"), scale)) if n else alone


def _longer(forward: DataFrame, scale: int) -> DataFrame:
    """The lines of edges as _through gives them."""
    turned = forward.select("gid", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("through2").alias("through1"), F.col("through1").alias("through2"))
    both = settled(forward.unionByName(turned).withColumn("id", F.monotonically_increasing_id()))
    leaving = both.where("through1").groupBy("gid", F.col("x1").alias("x"), F.col("y1").alias("y")).agg(F.min(F.struct("x2", "y2", "id")).alias("p"), F.max(F.struct("x2", "y2", "id")).alias("q"))
    # At a corner of two edges, the way on is the one that doesn't lead back.
    at = both.select("gid", F.col("x2").alias("x"), F.col("y2").alias("y"), "id", F.struct("x1", "y1").alias("came"))
    back = (F.col("p.x2") == F.col("came.x1")) & (F.col("p.y2") == F.col("came.y1"))
    links = at.join(leaving, ["gid", "x", "y"], "left").select("id", F.when(back, F.col("q.id")).otherwise(F.col("p.id")).alias("next"))
    place = walks(links)
    rows = both.join(place, "id")
    size = rows.groupBy("gid", "head", "cyclic").agg(
        F.count("*").alias("n"), F.min(F.struct("x1", "y1", "x2", "y2")).alias("least"), F.min_by(F.struct("x1", "y1"), -F.col("offset")).alias("start"), F.min_by(F.struct("x2", "y2"), "offset").alias("end"),
        F.min_by("offset", F.struct("x1", "y1", "x2", "y2")).alias("least_at"),
    )
    # Both directions are there: the one that begins at the lesser end stays, of a loop the one whose least corner leads to the lesser neighbour.
    towards = F.struct(F.col("least.x2"), F.col("least.y2"))
    rows = rows.join(size, ["gid", "head", "cyclic"])
    before = rows.where("cyclic and x2 = least.x1 and y2 = least.y1").select("gid", "head", F.struct("x1", "y1").alias("previous"))
    # A line that ends where it began, at a junction, is there twice: the walk whose first step is the lesser one stays.
    first_step = F.min_by(F.struct("x2", "y2"), -F.col("offset"))
    last_step = F.min_by(F.struct("x1", "y1"), "offset")
    ways = rows.groupBy("gid", "head").agg(first_step.alias("first_step"), last_step.alias("last_step"))
    keep = size.join(before, ["gid", "head"], "left").join(ways, ["gid", "head"]).where(
        F.when(F.col("cyclic"), towards < F.col("previous")).when(F.col("start") != F.col("end"), F.col("start") < F.col("end")).otherwise(F.col("first_step") < F.col("last_step"))
    )
    rows = rows.join(keep.select("gid", "head"), ["gid", "head"], "left_semi")
    offset = F.when(F.col("cyclic"), F.pmod(F.col("offset") - F.col("least_at"), F.col("n"))).otherwise(F.col("offset"))
    order = in_order(F.col("n"), offset, F.col("cyclic"))
    corner = lambda x, y: F.struct((F.col(x) / scale).alias("x"), (F.col(y) / scale).alias("y"))
    found = rows.groupBy("gid", "head", "cyclic").agg(
        F.count("*").alias("n"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / scale).alias("length"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), corner("x1", "y1").alias("p"), corner("x2", "y2").alias("q")))).alias("s"),
    )
    points = F.concat(F.transform("s", lambda s: s["p"]), F.array(F.element_at("s", -1)["q"]))
    return found.select("gid", F.col("head").alias("line_id"), "n", (F.get("s", F.lit(0))["p"] == F.element_at("s", -1)["q"]).alias("closed"), "length", points.alias("points"))
