"""Planar and spherical measures of rings and lines (arrays of structs x, y) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrachron.functions.numeric import EARTH_RADIUS_KM, haversine_m


def longitude(x: Column) -> Column:
    """To the half-open range -180 to 180; 180 becomes -180."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def longitude_closed(x: Column) -> Column:
    """To the closed range -180 to 180: values inside stay as they are."""
    return F.when(x.between(-180, 180), x).otherwise(F.when((longitude(x) == -180) & (x > 180), 180.0).otherwise(longitude(x)))


def unwrapped(lon: Column, first: Column) -> Column:
    """A longitude moved by full turns to within 180 degrees of another."""
    return lon - 360 * F.floor((lon - first) / 360 + 0.5)


def boxes(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One or two boxes that don't cross the antimeridian; the whole turn for a span of 360 degrees or more."""
    box = lambda w, e: F.struct(w.alias("w"), south.alias("s"), e.alias("e"), north.alias("n"))
    w, e = longitude(west), longitude_closed(east)
    whole = F.array(box(F.lit(-180.0), F.lit(180.0)))
    two = F.array(box(w, F.lit(180.0)), box(F.lit(-180.0), e))
    return F.when(F.abs(east - west) >= 360, whole).when(w <= e, F.array(box(w, e))).otherwise(two)


def boxes_meet(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    return (w1 <= e2) & (w2 <= e1) & (s1 <= n2) & (s2 <= n1)


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))


def _steps(points: Column) -> Column:
    """Each point with the next one."""
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).otherwise(F.array())


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive anticlockwise."""
    return _sum(F.transform(_steps(ring), lambda s: (s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2))


def polygon_area(rings: Column) -> Column:
    """The first ring's area less the others', not below zero."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.greatest(F.lit(0.0), F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - _sum(F.slice(areas, 2, F.greatest(F.size(areas), F.lit(1)))))


def spherical_area_km2(ring: Column) -> Column:
    """Area on the sphere between a closed ring's edges and the equator, by the trapezium rule on sines."""
    parts = F.transform(_steps(ring), lambda s: F.radians(s["x2"] - s["x1"]) * (2 + F.sin(F.radians(s["y1"])) + F.sin(F.radians(s["y2"]))))
    return F.abs(_sum(parts)) * EARTH_RADIUS_KM * EARTH_RADIUS_KM / 2


def line_km(points: Column) -> Column:
    present = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return _sum(F.transform(_steps(present), lambda s: haversine_m(s["x1"], s["y1"], s["x2"], s["y2"]))) / 1000


def length_degrees(points: Column) -> Column:
    """Length in degrees; a step never goes further round than half a turn."""
    return _sum(F.transform(_steps(points), lambda s: F.hypot(unwrapped(s["x2"] - s["x1"], F.lit(0.0)), s["y2"] - s["y1"])))


def vertex_mean(ring: Column) -> Column:
    """Mean of a closed ring's vertices, the closing one left out."""
    n = F.greatest(F.size(ring) - 1, F.lit(1))
    open_ring = F.slice(ring, 1, n)
    mean = lambda c: _sum(F.transform(open_ring, lambda p: p[c])) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """0 outside, 1 inside, 2 on the boundary (within 1e-10)."""
    steps = _steps(ring)

    def on(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        cross = dx * (y - s["y1"]) - dy * (x - s["x1"])
        return (F.abs(cross) <= 1e-10) & x.between(F.least(s["x1"], s["x2"]) - 1e-10, F.greatest(s["x1"], s["x2"]) + 1e-10) & y.between(F.least(s["y1"], s["y2"]) - 1e-10, F.greatest(s["y1"], s["y2"]) + 1e-10)

    def crossed(s: Column) -> Column:
        at = s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0))
        return ((s["y1"] > y) != (s["y2"] > y)) & F.coalesce(x < at, F.lit(False))

    odd = F.aggregate(steps, F.lit(0), lambda a, s: a + crossed(s).cast("int")) % 2
    return F.when(F.exists(steps, on), 2).otherwise(odd)


def simplify_key(x: Column, y: Column, digits: int = 7) -> Column:
    """The text of a node on the grid of so many decimals, halves away from zero."""
    return F.concat_ws(",", F.format_number(F.round(x.cast("decimal(20,12)"), digits), digits), F.format_number(F.round(y.cast("decimal(20,12)"), digits), digits))


def densify(points: Column, most: float) -> Column:
    """A line with points added so that no step is longer than `most` degrees."""
    def parts(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(s["x2"] - s["x1"]), F.abs(s["y2"] - s["y1"])) / most).cast("int"))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((s["x1"] + (s["x2"] - s["x1"]) * i / n).alias("x"), (s["y1"] + (s["y2"] - s["y1"]) * i / n).alias("y")))

    return F.concat(F.slice(points, 1, 1), F.flatten(F.transform(_steps(points), parts)))
