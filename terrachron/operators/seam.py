"""Rings on the globe: unwrapped by running turns, cut at the antimeridian, closed over the poles; point tests and areas that know the seam.

Rings are arrays of structs x, y in degrees, closed, in which an edge always goes the shorter way round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.geometry import _steps, _sum, bounds, longitude, unwrapped
from terrachron.functions.numeric import EARTH_RADIUS_KM
from terrachron.operators import overlay as ov
from terrachron.sources.shared import settled

RING = "array<struct<x:double,y:double>>"


def _turns(ring: Column) -> Column:
    """Edges as structs: where they begin, how far they go east (the shorter way), and their latitudes."""
    return F.transform(_steps(ring), lambda s: F.struct(s["x1"].alias("x"), unwrapped(s["x2"] - s["x1"], F.lit(0.0)).alias("dx"), s["y1"].alias("y1"), s["y2"].alias("y2")))


def turns_round(ring: Column) -> Column:
    """How often a ring goes round the globe, eastwards: 0, or 1 or -1 for a ring round a pole."""
    return F.round(_sum(F.transform(_turns(ring), lambda s: s["dx"])) / 360).cast("int")


def spherical_area_km2(ring: Column) -> Column:
    """The area on the sphere that a ring bounds, by the trapezium rule on sines: the lesser one of the two sides of a ring round a pole."""
    south = F.abs(_sum(F.transform(_turns(ring), lambda s: F.radians(s["dx"]) * (2 + F.sin(F.radians(s["y1"])) + F.sin(F.radians(s["y2"])))))) / 2
    whole = 4 * np.pi
    return F.when(turns_round(ring) == 0, south).otherwise(F.least(south, whole - south)) * EARTH_RADIUS_KM * EARTH_RADIUS_KM


def spherical_polygon_km2(rings: Column) -> Column:
    """The first ring's area less those of its holes, not below 0."""
    areas = F.transform(rings, spherical_area_km2)
    return F.greatest(F.lit(0.0), F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - _sum(F.slice(areas, 2, F.greatest(F.size(areas), F.lit(1)))))


def located(lon: Column, lat: Column, ring: Column) -> Column:
    """0 outside, 1 inside, 2 on the boundary (within 1e-10 degrees): edges north of a point on its meridian are counted, and the pole is inside a ring round it."""

    def of(s: Column, f) -> Column:
        # Where the edge begins, from the point's meridian, such that an edge over it isn't missed.
        at = unwrapped(s["x"] - lon, F.lit(0.0))
        return f(at) | f(at - 360) | f(at + 360)

    def crossed(s: Column) -> Column:
        return of(s, lambda at: ((at > 0) != (at + s["dx"] > 0)) & (s["y1"] + (s["y2"] - s["y1"]) * (-at) / F.when(s["dx"] == 0, F.lit(None)).otherwise(s["dx"]) > lat))

    def touched(s: Column) -> Column:
        size = F.greatest(F.hypot(s["dx"], s["y2"] - s["y1"]), F.lit(1e-300))

        def near(at: Column) -> Column:
            along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-at * s["dx"] + (lat - s["y1"]) * (s["y2"] - s["y1"])) / (size * size)))
            return F.hypot(at + along * s["dx"], s["y1"] + along * (s["y2"] - s["y1"]) - lat) <= 1e-10

        return of(s, near)

    edges = _turns(ring)
    odd = F.aggregate(edges, F.lit(0), lambda n, s: n + F.coalesce(crossed(s), F.lit(False)).cast("int")) % 2
    north = (turns_round(ring) != 0) & (mean_latitude(ring) >= 0)
    return F.when(F.exists(edges, touched), 2).otherwise((odd + north.cast("int")) % 2)


def mean_latitude(ring: Column) -> Column:
    return _sum(F.transform(ring, lambda p: p["y"])) / F.greatest(F.size(ring), F.lit(1))


def edge_boxes(ring: Column) -> Column:
    """The boxes of all edges, in longitudes of -180 to 180: two for an edge over the seam."""

    def of(s: Column) -> Column:
        w = longitude(F.least(s["x"], s["x"] + s["dx"]))
        e = w + F.abs(s["dx"])
        box = lambda a, b: F.struct(a.alias("w"), F.least(s["y1"], s["y2"]).alias("s"), b.alias("e"), F.greatest(s["y1"], s["y2"]).alias("n"))
        return F.when(e <= 180, F.array(box(w, e))).otherwise(F.array(box(w, F.lit(180.0)), box(F.lit(-180.0), e - 360)))

    return F.flatten(F.transform(_turns(ring), of))


def _unwrap(xy: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes without jumps, for all rings at once, and how far each ring's last corner then is from its first."""
    x = xy[:, 0].copy()
    step = np.diff(x, prepend=x[:1])
    turn = -360 * np.floor(step / 360 + 0.5)
    turn[starts[:-1][np.diff(starts) > 0]] = 0
    total = np.cumsum(turn)
    size = np.diff(starts)
    some = size > 0
    base = np.zeros(len(size))
    base[some] = total[starts[:-1][some]]
    x += total - np.repeat(base, size)
    gone = np.zeros(len(size))
    gone[some] = x[starts[1:][some] - 1] - x[starts[:-1][some]]
    return x, gone


def unwrapped_ring(ring: Column) -> Column:
    """A ring without jumps at the seam; one round a pole is led over the pole nearer to it and closed (G24, first half). Null stays null."""

    def run(rings: pa.Array) -> pa.Array:
        flat = rings.flatten()
        xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1) if len(flat) else np.zeros((0, 2))
        starts = np.concatenate([[0], np.cumsum(rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        x, gone = _unwrap(xy, starts)
        size = np.diff(starts)
        polar = np.abs(gone) > 180
        # A ring round a pole gets three corners more: the pole at either end, and its first corner.
        more = np.where(polar, 3, 0)
        ends = np.concatenate([[0], np.cumsum(size + more)])
        out = np.empty((ends[-1], 2))
        place = np.arange(len(x)) + np.repeat(ends[:-1] - starts[:-1], size)
        out[place, 0], out[place, 1] = x, xy[:, 1]
        for i in np.flatnonzero(polar):
            a, b = starts[i], starts[i + 1]
            pole = 90.0 if xy[a:b, 1].mean() >= 0 else -90.0
            out[ends[i + 1] - 3 : ends[i + 1]] = [[x[b - 1], pole], [x[a], pole], [x[a], xy[a, 1]]]
        values = pa.StructArray.from_arrays([pa.array(out[:, i]) for i in (0, 1)], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=rings.is_null())

    return F.arrow_udf(run, RING)(ring)


def cut_at_seam(rings: DataFrame, scale: int = ov.SCALE) -> DataFrame:
    """(id, polygon_id, area, rings) of rings (id, hole, ring): the same area as polygons between -180 and 180 degrees.

    Rings are unwrapped, each id is overlaid with every turn of the globe that it reaches, and what lies there is moved back. Areas are in square
    degrees. Holes may lie on another turn than their outer ring: they are moved to it first.
    """
    flat = rings.select("id", F.coalesce("hole", F.lit(False)).alias("hole"), unwrapped_ring(F.col("ring")).alias("ring")).where(F.size("ring") > 3)
    flat = settled(flat.withColumn("b", bounds(F.col("ring"))))
    outer = flat.where("not hole").groupBy("id").agg(F.min("b.w").alias("west"), F.max("b.e").alias("east"))
    rows = flat.join(outer, "id")
    # A hole's middle is brought within half a turn of the middle of what holds it.
    middle = (F.col("west") + F.col("east")) / 2
    own = (F.col("b.w") + F.col("b.e")) / 2
    shift = F.when(F.col("hole"), unwrapped(own, middle) - own).otherwise(0.0)
    rows = rows.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + shift).alias("x"), p["y"].alias("y"))))
    first, last = F.floor((F.col("west") + 180) / 360), F.ceil((F.col("east") + 180) / 360) - 1
    rows = rows.withColumn("turn", F.explode(F.sequence(first, F.greatest(first, last))))
    moved = rows.select(F.struct("id", "turn").alias("gid"), F.lit("a").alias("side"), "hole", F.transform("ring", lambda p: F.struct((p["x"] - 360 * F.col("turn")).alias("x"), p["y"].alias("y"))).alias("ring"))
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    globe = F.array(*(corner(x, y) for x, y in ((-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90))))
    windows = moved.select("gid").distinct().select("gid", F.lit("b").alias("side"), F.lit(False).alias("hole"), globe.alias("ring"))
    pieces = ov.overlay(moved.unionByName(windows), "intersection", scale)
    return ov.polygons(pieces, ["gid"], scale).select("gid.id", "polygon_id", "area", "rings")


def refined(rings: DataFrame, scale: int = ov.SCALE) -> DataFrame:
    """(gid, owner, ring_id, n, area, ring) of rings (gid, owner, hole, ring): the same shapes with a corner wherever another shape of the map touches or crosses an edge.

    Then neighbours have whole edges in common, as `shared_borders` and `simplified_map` ask for.
    """
    named = ov.ring_edges(rings.select(F.struct("gid", "owner").alias("gid"), F.lit("a").alias("side"), "hole", "ring"), scale)
    every = ov.pieces_of(named.select("gid.gid", *ov.ENDS)).withColumnsRenamed({f"of_{c}": f"o{c}" for c in ov.ENDS})
    # A piece belongs to whoever has the edge that it comes from; pieces of two edges of one owner may cancel.
    owned = named.select("gid.gid", "gid.owner", *(F.col(c).alias(f"o{c}") for c in ov.ENDS), "a")
    rows = owned.join(every, ["gid", *(f"o{c}" for c in ov.ENDS)])
    summed = ov.net(rows.select(F.struct("gid", "owner").alias("gid"), *ov.ENDS, (F.col("a") * F.col("way")).alias("a"), F.lit(0).cast("long").alias("b")))
    ahead = F.col("a") > 0
    # An edge that an owner runs through several times counts so often.
    pieces = summed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("a"))))
    turn = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    edges = pieces.select("gid.gid", "gid.owner", turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))
    return ov.walked(edges, ["gid", "owner"], scale)
