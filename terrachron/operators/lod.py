"""Simplified maps whose neighbours still fit: borders are cut into arcs, each arc is simplified once and put back into every ring that has it.

Arcs end where other than two edges meet. An arc keeps its ends; a loop, or one of several arcs between the same two ends, keeps corners
enough to hold its area. Simplified arcs that touch or cross anything are put back as they were, until none does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.operators import overlay as ov
from terrachron.sources.shared import counted, settled

POINTS = "array<struct<x:double,y:double>>"


def kept_corners(xy: np.ndarray, starts: np.ndarray, tolerance: float, least: np.ndarray) -> np.ndarray:
    """Douglas-Peucker over many lines at once: which corners of xy stay, where line i is xy[starts[i]:starts[i + 1]].

    Each round takes all stretches between kept corners and splits those whose furthest corner is further off than the tolerance.
    least: how many corners between its ends a line keeps if it has them (0 to 2), whatever the tolerance.
    """
    kept = np.zeros(len(xy), bool)
    a, b = starts[:-1], starts[1:] - 1
    line = np.flatnonzero(b >= a)
    a, b = a[line], b[line]
    kept[a] = kept[b] = True
    have = np.zeros(len(starts) - 1, np.int64)
    while True:
        some = b - a > 1
        a, b, line = a[some], b[some], line[some]
        if not len(a):
            return kept
        n = b - a - 1
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - first[of] + a[of] + 1
        base, off = xy[b] - xy[a], xy[at] - xy[a][of]
        size = (base * base).sum(axis=1)[of]
        along = np.clip(np.divide((off * base[of]).sum(axis=1), size, out=np.zeros(len(at)), where=size > 0), 0, 1)
        away = np.hypot(*(off - along[:, None] * base[of]).T)
        most = np.maximum.reduceat(away, first)
        far = np.minimum.reduceat(np.where(away == most[of], at, len(xy)), first)
        split = most > tolerance
        # Of a line that still lacks corners, the stretch with the furthest one is split in any case.
        lacks = have[line] < least[line]
        if lacks.any():
            order = np.lexsort((-most, line))
            leads = order[np.r_[True, line[order][1:] != line[order][:-1]]]
            forced = np.zeros(len(a), bool)
            forced[leads] = True
            split |= forced & lacks
        a, b, line, far = a[split], b[split], line[split], far[split]
        kept[far] = True
        np.add.at(have, line, 1)
        a, b, line = np.concatenate([a, far]), np.concatenate([far, b]), np.concatenate([line, line])


def simplified(points: Column, tolerance: float, least: Column | None = None) -> Column:
    """Lines without the corners that lie within a tolerance of what is left; all lines of a batch at once. Null stays null."""

    def run(lines: pa.Array, counts: pa.Array) -> pa.Array:
        flat = lines.flatten()
        xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(flat) else np.zeros((0, 2))
        sizes = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        kept = kept_corners(xy, starts, tolerance, counts.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(kept)])[starts].astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(xy[kept, i]) for i in (0, 1)], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=lines.is_null())

    return F.arrow_udf(run, POINTS)(points, F.lit(0) if least is None else least)


def _pairs(lines: DataFrame, points: str, scale: int) -> DataFrame:
    """Undirected edges (gid, line_id, x1, y1, x2, y2) of lines, on the grid; forward tells the line's way."""
    at = lambda p, c: F.round(p[c] * scale).cast("long")
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("p"), F.get(points, i).alias("q")))
    rows = lines.select("gid", "line_id", F.explode(steps).alias("s")).select("gid", "line_id", *(at(F.col(f"s.{p}"), c).alias(f"{p}{c}") for p in "pq" for c in "xy"))
    forward = F.struct("px", "py") < F.struct("qx", "qy")
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    return rows.select("gid", "line_id", pick("px", "qx").alias("x1"), pick("py", "qy").alias("y1"), pick("qx", "px").alias("x2"), pick("qy", "py").alias("y2"), forward.alias("forward"))


def simplified_map(rings: DataFrame, tolerance: float, scale: int = ov.SCALE) -> DataFrame:
    """(gid, owner, ring_id, n, area, ring) of rings (gid, owner, hole, ring): the rings of each owner of a map (gid), simplified together.

    Neighbours have equal edges before and after. A hole's area is negative. Rings without area are left out, repeated ones count once.
    """
    owned = ov.ring_edges(rings.select(F.struct("gid", "owner").alias("gid"), F.lit("a").alias("side"), "hole", "ring"), scale)
    owned = settled(owned.select("gid.gid", "gid.owner", *ov.ENDS, "a"))
    lines = ov.chains(owned.select("gid", *ov.ENDS).distinct(), scale).select("gid", "line_id", "closed", "points")
    ends = F.array_sort(F.array(F.get("points", F.lit(0)), F.element_at("points", -1)))
    lines = settled(lines.withColumn("ends", ends))
    twins = lines.groupBy("gid", "ends").agg(F.count("*").alias("twins"))
    least = F.when(F.col("closed"), 2).when(F.col("twins") > 1, 1).otherwise(0)
    lines = lines.join(twins, ["gid", "ends"]).select("gid", "line_id", "points", simplified(F.col("points"), tolerance, least).alias("short"))
    lines = settled(lines.withColumn("whole", F.size("short") == F.size("points")))
    while True:
        now = settled(_pairs(lines, "short", scale))
        cut = ov._cuts(now.select("gid", *ov.ENDS).distinct(), ov.CELL)
        # An edge with a cut inside, the edges at the point that cuts it, and edges that two arcs have.
        touched = cut.select("gid", *ov.ENDS)
        corner = cut.select("gid", F.col("px").alias("x"), F.col("py").alias("y")).distinct()
        of = now.join(touched.distinct(), ["gid", *ov.ENDS], "left_semi").select("gid", "line_id")
        for x, y in (("x1", "y1"), ("x2", "y2")):
            of = of.unionByName(now.join(corner.select("gid", F.col("x").alias(x), F.col("y").alias(y)), ["gid", x, y], "left_semi").select("gid", "line_id"))
        double = now.groupBy("gid", *ov.ENDS).agg(F.countDistinct("line_id").alias("k")).where("k > 1").select("gid", *ov.ENDS)
        of = of.unionByName(now.join(double, ["gid", *ov.ENDS], "left_semi").select("gid", "line_id"))
        bad, n = counted(of.distinct().join(lines.where("not whole").select("gid", "line_id"), ["gid", "line_id"], "left_semi"))
        if not n:
            break
        lines = settled(lines.join(bad.withColumn("_bad", F.lit(True)), ["gid", "line_id"], "left").select("gid", "line_id", "points", F.when(F.col("_bad"), F.col("points")).otherwise(F.col("short")).alias("short"), (F.col("whole") | F.coalesce("_bad", F.lit(False))).alias("whole")))
    # Which way each owner runs along an arc shows at the arc's first edge.
    first = _pairs(lines.select("gid", "line_id", F.slice("points", 1, 2).alias("points")), "points", scale).withColumnRenamed("forward", "line_forward")
    sides = owned.join(first, ["gid", *ov.ENDS]).select("gid", "owner", "line_id", ((F.col("a") > 0) == F.col("line_forward")).alias("with_line"))
    edges = sides.join(now, ["gid", "line_id"])
    ahead = F.col("forward") == F.col("with_line")
    turn = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    edges = edges.select("gid", "owner", turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))
    return ov.walked(edges, ["gid", "owner"], scale)
