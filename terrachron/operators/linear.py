"""Linear referencing: where lines run along others, as measures on both; substrings by measure; lines put onto what they follow.

Lines are rows (id, points) in plane coordinates. Segments meet by cells of doubling size; no line is compared with another
as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.operators import cells
from terrachron.sources.shared import counted, settled

#: Kilometres for a degree of longitude at the equator, and of latitude: fixed values of the local metric frame.
EAST_KM, NORTH_KM = 111.32, 110.57


def metric(points: Column, latitude: Column) -> Column:
    """Degrees as kilometres of a plane that is true at a latitude."""
    east = EAST_KM * F.cos(F.radians(latitude))
    return F.transform(points, lambda p: F.struct((p["x"] * east).alias("x"), (p["y"] * NORTH_KM).alias("y")))


def segments(lines: DataFrame) -> DataFrame:
    """(id, seq, x1, y1, x2, y2, m1, m2, last) of lines (id, points): m1 and m2 are the measures of a segment's ends, last marks a line's end. Steps without length are left out."""
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.get("points", i).alias("q")))
    rows = lines.where(F.size("points") > 1).select("id", F.posexplode(steps).alias("seq", "s"))
    rows = rows.select("id", "seq", *(F.col(f"s.{p}.{c}").alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy")).dropna()
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    w = Window.partitionBy("id").orderBy("seq")
    rows = rows.withColumn("size", size).where("size > 0").withColumn("m2", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("id", "seq", "x1", "y1", "x2", "y2", (F.col("m2") - F.col("size")).alias("m1"), "m2", F.lead("seq").over(w).isNull().alias("last"), F.lag("seq").over(w).isNull().alias("first"))


def _clip(lo: Column, hi: Column, k: Column, m: Column) -> tuple[Column, Column]:
    """The part of lo to hi where k + m t isn't negative; where m is 0 and k negative, none (null)."""
    at = -k / F.nullif(m, F.lit(0.0))
    low = F.when(m > 0, F.greatest(lo, at)).when((m == 0) & (k < 0), F.lit(2.0)).otherwise(lo)
    return low, F.when(m < 0, F.least(hi, at)).otherwise(hi)


def _along(reach: float) -> list[Column]:
    """Intervals of t on a segment a that lie within reach of a segment b: beside it, and round its inner corners. Null where there is none."""
    ax, ay = F.col("ax1"), F.col("ay1")
    dx, dy = F.col("ax2") - ax, F.col("ay2") - ay
    bx, by, ex, ey = F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2")
    size = F.hypot(ex - bx, ey - by)
    ux, uy = (ex - bx) / size, (ey - by) / size
    s0, sd = (ax - bx) * ux + (ay - by) * uy, dx * ux + dy * uy
    n0, nd = (ay - by) * ux - (ax - bx) * uy, dy * ux - dx * uy
    lo, hi = F.lit(0.0), F.lit(1.0)
    for k, m in ((s0, sd), (size - s0, -sd), (reach - n0, -nd), (reach + n0, nd)):
        lo, hi = _clip(lo, hi, k, m)
    found = [(lo, hi, F.lit(True))]
    for cx, cy, inner in ((bx, by, ~F.col("bfirst")), (ex, ey, ~F.col("blast"))):
        a, b, c = dx * dx + dy * dy, (ax - cx) * dx + (ay - cy) * dy, (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) - reach * reach
        root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
        found.append((F.greatest((-b - root) / a, F.lit(0.0)), F.least((-b + root) / a, F.lit(1.0)), inner & (b * b >= a * c)))
    return [F.when(on & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi"))) for lo, hi, on in found]


def near_segments(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs of segments whose boxes come within reach, on both axes: all columns of either, with a and b before them."""
    size = max(reach, 1e-9)
    sides, lows, highs = [], [], []
    for df, s, wide in ((a, "a", reach), (b, "b", 0.0)):
        sides.append(df.select(*(F.col(c).alias(f"{s}{c}") for c in df.columns)))
        lows.append([F.least(f"{s}{c}1", f"{s}{c}2") - wide for c in "xy"])
        highs.append([F.greatest(f"{s}{c}1", f"{s}{c}2") + wide for c in "xy"])
    sides = [df.withColumn("level", cells.level_of(F.greatest(*(h - l for l, h in zip(lo, hi, strict=True))), size)) for df, lo, hi in zip(sides, lows, highs, strict=True)]
    levels = cells.occurring(*(s.select("level") for s in sides))
    own = [cells.own_cells(s, size, lo, hi).drop("level") for s, lo, hi in zip(sides, lows, highs, strict=True)]
    above = [cells.coarser_cells(s, levels, size, lo, hi).drop("level") for s, lo, hi in zip(sides, lows, highs, strict=True)]
    at = ["_level", "_c0", "_c1"]
    pairs = own[0].join(own[1].unionByName(above[1]), at).unionByName(above[0].join(own[1], at))
    meet = reduce(lambda x, y: x & y, [(lows[0][i] <= highs[1][i]) & (lows[1][i] <= highs[0][i]) & cells.first_shared(size, i, lows[0][i], lows[1][i]) for i in (0, 1)])
    return pairs.where(meet).drop(*at)


def runs_along(lines: DataFrame, others: DataFrame, reach: float, shortest: float = 0.0, gap: float = 1e-6) -> DataFrame:
    """(a, b, run_no, from_a, to_a, from_b, to_b): the stretches of lines (id, points) that lie within reach of another line.

    from_a and to_a are measures along the line, from_b and to_b those of the other line's points nearest to the stretch's ends. Around the ends of
    the other line nothing counts that isn't beside it. Stretches that come within `gap` are one; those shorter than `shortest` are left out.
    """
    pairs = near_segments(segments(lines), segments(others), reach)
    found = pairs.withColumn("_i", F.explode(F.filter(F.array(*_along(reach)), lambda i: i.isNotNull())))
    length = F.col("am2") - F.col("am1")

    def at_b(t: Column) -> Column:
        x, y = F.col("ax1") + t * (F.col("ax2") - F.col("ax1")), F.col("ay1") + t * (F.col("ay2") - F.col("ay1"))
        dx, dy = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("bx1")) * dx + (y - F.col("by1")) * dy) / (dx * dx + dy * dy)))
        off = F.hypot(x - F.col("bx1") - share * dx, y - F.col("by1") - share * dy)
        return F.struct(off.alias("off"), (F.col("bm1") + share * (F.col("bm2") - F.col("bm1"))).alias("m"))

    rows = found.select(
        F.col("aid").alias("a"), F.col("bid").alias("b"), (F.col("am1") + F.col("_i.lo") * length).alias("lo"), (F.col("am1") + F.col("_i.hi") * length).alias("hi"),
        at_b(F.col("_i.lo")).alias("at_lo"), at_b(F.col("_i.hi")).alias("at_hi"),
    )
    w = Window.partitionBy("a", "b").orderBy("lo", "hi")
    until = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("lo") > until + gap, 1).when(until.isNull(), 1).otherwise(0))
    rows = rows.withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The measure on b of the ends: of all segments that hold an end, the nearest one counts.
    runs = rows.groupBy("a", "b", "run_no").agg(
        F.min("lo").alias("from_a"), F.max("hi").alias("to_a"), F.min(F.struct(F.round("lo", 9).alias("k"), F.col("at_lo.off").alias("o"), F.col("at_lo.m").alias("m"))).alias("first"),
        F.min(F.struct((-F.round("hi", 9)).alias("k"), F.col("at_hi.off").alias("o"), F.col("at_hi.m").alias("m"))).alias("end"),
    )
    runs = runs.select("a", "b", "from_a", "to_a", F.col("first.m").alias("from_b"), F.col("end.m").alias("to_b")).where(F.col("to_a") - F.col("from_a") >= shortest)
    by = F.row_number().over(Window.partitionBy("a", "b").orderBy("from_a"))
    return runs.select("a", "b", by.alias("run_no"), "from_a", "to_a", "from_b", "to_b")


def accepted_runs(runs: DataFrame, most: float = 0.5) -> DataFrame:
    """Runs of one line that don't share more than `most` with a better one that is accepted: the longer is better, then the lesser b.

    In rounds: a run is accepted once no better one in its way is open, and refused once an accepted one is; a round costs one join of the runs with themselves by line.
    """
    rank = F.row_number().over(Window.partitionBy("a").orderBy((F.col("from_a") - F.col("to_a")), "b", "run_no"))
    ranked = settled(runs.withColumn("rank", rank))
    x, y = (ranked.select(F.col("a"), *(F.col(c).alias(f"{c}_{s}") for c in ("rank", "from_a", "to_a"))) for s in "xy")
    shared = F.least("to_a_x", "to_a_y") - F.greatest("from_a_x", "from_a_y")
    ways = settled(x.join(y, "a").where((F.col("rank_y") < F.col("rank_x")) & (shared > most)).select("a", F.col("rank_x").alias("rank"), F.col("rank_y").alias("better")))
    state = ranked.select("a", "rank", F.lit(0).alias("state"))
    while True:
        better = state.select("a", F.col("rank").alias("better"), F.col("state").alias("of"))
        seen = ways.join(better, ["a", "better"]).groupBy("a", "rank").agg(F.max(F.when(F.col("of") == 1, 1).otherwise(0)).alias("blocked"), F.max(F.when(F.col("of") == 0, 1).otherwise(0)).alias("waits"))
        nxt = F.when(F.col("state") != 0, F.col("state")).when(F.col("blocked") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        state, undecided = counted(state.join(seen, ["a", "rank"], "left").select("a", "rank", nxt.alias("state")), F.col("state") == 0)
        if not undecided:
            break
    return ranked.join(state.where("state = 1").select("a", "rank"), ["a", "rank"]).drop("rank")


def substrings(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, no, points): the parts of lines (id, points) between two measures, of cuts (id, no, from_m, to_m); run backwards where to_m is less."""
    lo, hi = F.least("from_m", "to_m"), F.greatest("from_m", "to_m")
    rows = segments(lines).join(cuts.withColumns({"lo": lo, "hi": hi}), "id").where((F.col("m2") >= F.col("lo")) & (F.col("m1") <= F.col("hi")))

    def at(m: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m - F.col("m1")) / (F.col("m2") - F.col("m1"))))
        return F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))

    ends = F.struct(F.col("seq"), at(F.greatest("m1", "lo")).alias("p"), at(F.least("m2", "hi")).alias("q"))
    found = rows.groupBy("id", "no").agg(F.array_sort(F.collect_list(ends)).alias("s"), F.first(F.col("from_m") > F.col("to_m")).alias("back"))
    points = F.flatten(F.transform("s", lambda s: F.array(s["p"], s["q"])))
    kept = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    return found.select("id", "no", F.when(F.col("back"), F.reverse(kept)).otherwise(kept).alias("points"))


def aligned(lines: DataFrame, others: DataFrame, reach: float, shortest: float, most: float = 0.5) -> DataFrame:
    """(a, no, b, points): lines cut where they come to run along another line, and put onto it there (b: which, null where the line stays itself).

    A stretch that two others claim goes to the longer run; the part of a run that a better one has taken is left to that.
    """
    runs = settled(accepted_runs(runs_along(lines, others, reach, shortest), most))
    ends = segments(lines).groupBy(F.col("id").alias("a")).agg(F.max("m2").alias("length"))
    w = Window.partitionBy("a").orderBy("from_a", "to_a")
    on = runs.select("a", "b", "from_a", "to_a", "from_b", "to_b", F.coalesce(F.max("to_a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    plain = on.where(F.col("from_a") > F.col("before") + 1e-6).select("a", F.col("before").alias("from_m"), F.col("from_a").alias("to_m"))
    rest = ends.join(on.groupBy("a").agg(F.max("to_a").alias("from_m")), "a", "left").select("a", F.coalesce("from_m", F.lit(0.0)).alias("from_m"), F.col("length").alias("to_m"))
    plain = plain.unionByName(rest.where(F.col("to_m") > F.col("from_m") + 1e-6))
    every = plain.select("a", F.col("from_m").alias("start"), F.lit(None).cast(dict(runs.dtypes)["b"]).alias("b"), "from_m", "to_m").unionByName(on.select("a", F.col("from_a").alias("start"), "b", F.col("from_b").alias("from_m"), F.col("to_b").alias("to_m")))
    every = settled(every.withColumn("no", F.row_number().over(Window.partitionBy("a").orderBy("start"))))
    own = substrings(lines, every.where("b is null").select(F.col("a").alias("id"), "no", "from_m", "to_m")).select(F.col("id").alias("a"), "no", F.lit(None).cast(dict(runs.dtypes)["b"]).alias("b"), "points")
    key = F.struct("a", "no")
    border = substrings(others, every.where("b is not null").select(F.col("b").alias("id"), key.alias("no"), "from_m", "to_m")).select(F.col("no.a").alias("a"), F.col("no.no").alias("no"), F.col("id").alias("b"), "points")
    return own.unionByName(border).where(F.size("points") > 1)
