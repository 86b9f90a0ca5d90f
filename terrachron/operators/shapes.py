"""Rings and polygons: edges shared by owners, perimeters, ring issues, winding, containment, simplified lines.

Shapes that meet are found by joins on exact edges or grid cells. Only what depends on all vertices of one ring runs in
Arrow batches, ring by ring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.geometry import signed_area
from terrachron.operators.lod import kept_corners


def edges(rings: DataFrame, owner: str = "owner", ring: str = "ring", digits: int = 7) -> DataFrame:
    """(owner, x1, y1, x2, y2, forward): the edges of closed rings on a grid of so many decimals, least end first; edges without length are left out."""
    at = lambda p, c: F.round(p[c], digits)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(F.get(ring, i - 1).alias("p"), F.get(ring, i).alias("q")))
    rows = rings.select(owner, F.explode(steps).alias("e")).select(owner, *(at(F.col(f"e.{p}"), c).alias(f"{p}{c}") for p in "pq" for c in "xy")).dropna()
    forward = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    first = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    ends = [first("px", "qx").alias("x1"), first("py", "qy").alias("y1"), first("qx", "px").alias("x2"), first("qy", "py").alias("y2")]
    return rows.where((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy"))).select(owner, *ends, forward.alias("forward"))


def shared_borders(rings: DataFrame, owner: str = "owner", ring: str = "ring", digits: int = 7) -> DataFrame:
    """(a, b, n, length): owners with equal edges, how many and how long together. One aggregate by edge; no pair is compared."""
    of_edge = edges(rings, owner, ring, digits).groupBy("x1", "y1", "x2", "y2").agg(F.array_sort(F.collect_set(owner)).alias("owners")).where(F.size("owners") > 1)
    pairs = F.flatten(F.transform("owners", lambda a, i: F.transform(F.slice("owners", i + 2, F.size("owners")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return of_edge.withColumn("p", F.explode(pairs)).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.sum(length).alias("length"))


def perimeter(rings: DataFrame, owner: str = "owner", ring: str = "ring", digits: int = 6) -> DataFrame:
    """The edges that occur an odd number of times: those between two pieces of a mesh cancel."""
    found = edges(rings, owner, ring, digits).groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))
    return found.where("n % 2 = 1").select("x1", "y1", "x2", "y2")


def wound(ring: Column, anticlockwise: bool = True) -> Column:
    """A closed ring in the given sense of rotation; a ring without area stays as it is."""
    area = signed_area(ring)
    return F.when(area < 0 if anticlockwise else area > 0, F.reverse(ring)).otherwise(ring)


def is_wound(ring: Column, anticlockwise: bool = True) -> Column:
    return signed_area(ring) > 0 if anticlockwise else signed_area(ring) < 0


def polygon_statistics(polygons: Column) -> Column:
    """The struct (polygons, rings, positions, w, s, e, n) of a list of polygons, each a list of rings."""
    rings = F.flatten(polygons)
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.size(polygons).alias("polygons"), F.size(rings).alias("rings"), F.size(points).alias("positions"),
        F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"),
    )


def significant_area(area: Column, reference: Column) -> Column:
    """Whether an area counts beside a reference: above 1e-10 and above a thousand-millionth of it. NaN counts, as it can't be told."""
    return F.isnan(area) | (area > F.greatest(F.lit(1e-10), reference * 1e-9))


def overlap_decision(area: Column) -> Column:
    """none up to 1e-10, trace up to 1e-8, else overlap; NaN is an overlap. Null stays null."""
    return F.when(area.isNull(), F.lit(None).cast("string")).when(F.isnan(area), "overlap").when(area <= 1e-10, "none").when(area <= 1e-8, "trace").otherwise("overlap")


def equal_within(a: Column, b: Column, most: float = 2e-12) -> Column:
    """Whether two lines have as many vertices, each no further apart than `most` on either axis."""
    near = F.zip_with(a, b, lambda p, q: F.coalesce((F.abs(p["x"] - q["x"]) <= most) & (F.abs(p["y"] - q["y"]) <= most), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)


def _flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of a list column of structs (x, y), and where each list starts."""
    points = lines.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(points) else np.zeros((0, 2))
    return xy, np.concatenate([[0], np.cumsum(lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def proper_crossings(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which edges p-q and r-s cross inside both, as a matrix (edges of the first by edges of the second); of several rings at once if they have as many vertices."""
    p, q, r, s = p[..., :, None, :], q[..., :, None, :], r[..., None, :, :], s[..., None, :, :]
    return (_cross(p, q, r) * _cross(p, q, s) < 0) & (_cross(r, s, p) * _cross(r, s, q) < 0)


#: Rings of at most so many vertices are compared together with those that have as many, and so many pairs of vertices at a time.
SHORT, PAIRS = 64, 1 << 20


def _alike(known: np.ndarray, *sizes: np.ndarray):
    """Places of known rows with equal sizes of at most SHORT: blocks that are compared at once."""
    rows = np.flatnonzero(known & (np.maximum.reduce(sizes) <= SHORT))
    order = rows[np.lexsort([s[rows] for s in sizes])]
    new = np.logical_or.reduce([np.diff(s[order]) != 0 for s in sizes])
    for part in np.split(order, np.flatnonzero(new) + 1) if len(order) else []:
        most = max(1, PAIRS // int(max(s[part[0]] for s in sizes)) ** 2)
        yield from (part[i : i + most] for i in range(0, len(part), most))


def ring_issues(ring: Column) -> Column:
    """What is wrong with a ring, in order: few (fewer than four vertices), open, repeated (a vertex beside itself), flat (no area), crossing (edges cross).

    Edges are compared in blocks of a thousand, so a long ring needs little memory. An array without entries means a sound ring; null stays null.
    """

    def found(xy: np.ndarray) -> list[str]:
        out = []
        if len(xy) < 4:
            out.append("few")
        if len(xy) and (xy[0] != xy[-1]).any():
            out.append("open")
        if len(xy) > 1 and (xy[1:] == xy[:-1]).all(axis=1).any():
            out.append("repeated")
        x, y = (xy - xy[:1]).T
        if len(xy) < 3 or abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2 <= 1e-12:
            out.append("flat")
        a, b = xy[:-1], xy[1:]
        if any(proper_crossings(a[i : i + 1000], b[i : i + 1000], a[j : j + 1000], b[j : j + 1000]).any() for i in range(0, len(a), 1000) for j in range(i, len(a), 1000)):
            out.append("crossing")
        return out

    names = np.array(["few", "open", "repeated", "flat", "crossing"])

    def run(rings: pa.Array) -> pa.Array:
        xy, starts = _flat(rings)
        known, sizes = rings.is_valid().to_numpy(zero_copy_only=False), np.diff(starts)
        out = [found(xy[a:b]) if v and (n < 3 or n > SHORT) else None for a, b, v, n in zip(starts, starts[1:], known.tolist(), sizes.tolist())]
        for rows in _alike(known & (sizes > 2), sizes):
            n = int(sizes[rows[0]])
            p = xy[starts[rows][:, None] + np.arange(n)]
            x, y = np.moveaxis(p - p[:, :1], 2, 0)
            a, b = p[:, :-1], p[:, 1:]
            flat = np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1)) / 2 <= 1e-12
            marks = [np.full(len(p), n < 4), (p[:, 0] != p[:, -1]).any(axis=1), (a == b).all(axis=2).any(axis=1), flat, proper_crossings(a, b, a, b).any(axis=(1, 2))]
            for i, m in zip(rows.tolist(), np.stack(marks, axis=1)):
                out[i] = names[m].tolist()
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(ring)


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """0 outside, 1 inside, 2 on the boundary, for each point."""
    a, b = ring[..., None, :-1, :], ring[..., None, 1:, :]
    p = points[..., :, None, :]
    x, y = p[..., 0], p[..., 1]
    low, high = np.minimum(a, b) - 1e-10, np.maximum(a, b) + 1e-10
    on = (np.abs(_cross(a, b, p)) <= 1e-10) & (x >= low[..., 0]) & (x <= high[..., 0]) & (y >= low[..., 1]) & (y <= high[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1])
    hit = ((a[..., 1] > y) != (b[..., 1] > y)) & (x < at)
    return np.where(on.any(axis=-1), 2, hit.sum(axis=-1) % 2)


def contains(outer: Column, inner: Column) -> Column:
    """Whether a ring holds another: no edges cross, and no vertex or middle of an edge lies outside; null if a side is.

    A ring with fewer than four vertices holds nothing and is held by nothing.
    """

    def run(outers: pa.Array, inners: pa.Array) -> pa.Array:
        (p, at), (q, to) = _flat(outers), _flat(inners)
        known = outers.is_valid().to_numpy(zero_copy_only=False) & inners.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.diff(at), np.diff(to)
        rings = known & (np.minimum(*sizes) >= 4)
        out = np.where(known, False, None)
        for rows in _alike(rings, *sizes):
            a, b = p[at[rows][:, None] + np.arange(sizes[0][rows[0]])], q[to[rows][:, None] + np.arange(sizes[1][rows[0]])]
            held = (inside(np.concatenate([b[:, :-1], (b[:, :-1] + b[:, 1:]) / 2], axis=1), a) > 0).all(axis=1)
            out[rows] = held & ~proper_crossings(a[:, :-1], a[:, 1:], b[:, :-1], b[:, 1:]).any(axis=(1, 2))
        for i in np.flatnonzero(rings & (np.maximum(*sizes) > SHORT)).tolist():
            a, b = p[at[i] : at[i + 1]], q[to[i] : to[i + 1]]
            probes = np.concatenate([b[:-1], (b[:-1] + b[1:]) / 2])
            # A million pairs of points and edges at a time, however long the rings are.
            some = max(1, 1_000_000 // len(a))
            held = all((inside(probes[k : k + some], a) > 0).all() for k in range(0, len(probes), some))
            out[i] = held and not any(proper_crossings(a[:-1], a[1:], b[:-1][k : k + some], b[1:][k : k + some]).any() for k in range(0, len(b) - 1, some))
        return pa.array([None if v is None else bool(v) for v in out.tolist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(outer, inner)


def simplified(line: Column, tolerance: float) -> Column:
    """A line without vertices that lie within a tolerance of what is left (Douglas-Peucker); a step over half a turn is never bridged. Null stays null."""

    def run(lines: pa.Array) -> pa.Array:
        xy, starts = _flat(lines)
        # A line is cut where it jumps; all stretches of a batch are simplified at once.
        first = np.zeros(len(xy), bool)
        first[starts[:-1][np.diff(starts) > 0]] = True
        first[1:] |= np.abs(np.diff(xy[:, 0])) > 180
        cuts = np.append(np.flatnonzero(first), len(xy))
        kept = kept_corners(xy, cuts, tolerance, np.zeros(len(cuts) - 1, np.int64))
        offsets = np.concatenate([[0], np.cumsum(kept)])[starts].astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(xy[kept, k]) for k in (0, 1)], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lines.is_null())

    return F.arrow_udf(run, "array<struct<x:double,y:double>>")(line)


def clipped_lines(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Clipped segments (keys, order, part: struct x1, y1, x2, y2; null outside) joined into lines: (keys, line_no, points).

    A line goes on while the next segment begins where the last one ended. A key's line is one row in the end.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    rows = segments.where("part is not null").withColumn("_before", F.lag(F.struct(F.col(order).alias("o"), "part")).over(w))
    follows = (F.col(order) == F.col("_before.o") + 1) & (F.col("part.x1") == F.col("_before.part.x2")) & (F.col("part.y1") == F.col("_before.part.y2"))
    rows = rows.withColumn("line_no", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = rows.groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct(order, "part"))).alias("p"))
    point = lambda s, i: F.struct(s["part"][f"x{i}"].alias("x"), s["part"][f"y{i}"].alias("y"))
    return lines.select(*keys, "line_no", F.concat(F.array(point(F.col("p")[0], 1)), F.transform("p", lambda s: point(s, 2))).alias("points"))
