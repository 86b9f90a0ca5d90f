"""Map projections of the sphere as column expressions, forwards and backwards; degrees to metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from terrachron.functions.geometry import longitude
from terrachron.functions.numeric import EARTH_RADIUS_M

KINDS = ("geographic", "eqc", "merc", "lcc", "laea", "aeqd", "stere", "ortho")


def _point(x: Column, y: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def _cone(lat1: float, lat2: float, lat0: float) -> tuple[float, float, float]:
    """The cone's constant, factor and the radius at the origin, for a radius of 1."""
    a, b = math.radians(lat1), math.radians(lat2)
    half = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(a) if a == b else math.log(math.cos(a) / math.cos(b)) / math.log(half(b) / half(a))
    f = math.cos(a) * half(a) ** n / n
    return n, f, f / half(math.radians(lat0)) ** n


def forward(kind: str, lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0, lat1: float = 0.0, lat2: float | None = None, radius: float = EARTH_RADIUS_M) -> Column:
    """The struct (x, y) in metres (degrees for `geographic`); null outside the projection's domain."""
    valid = lon.between(-180, 180) & lat.between(-90, 90)
    if kind == "geographic":
        return _point(lon, lat, valid)
    phi, lam = F.radians(lat), F.radians(longitude(lon - lon0))
    p0 = math.radians(lat0)
    if kind == "eqc":
        return _point(radius * lam * math.cos(math.radians(lat1)), radius * (phi - p0), valid)
    if kind == "merc":
        return _point(radius * lam, radius * F.ln(F.tan(math.pi / 4 + phi / 2)), valid & (F.abs(lat) < 90))
    if kind == "lcc":
        n, f, rho0 = _cone(lat1, lat1 if lat2 is None else lat2, lat0)
        rho = f / F.pow(F.tan(math.pi / 4 + phi / 2), F.lit(n))
        return _point(radius * rho * F.sin(n * lam), radius * (rho0 - rho * F.cos(n * lam)), valid & (F.abs(lat) < 90))
    if kind == "stere":  # about a pole
        sign = 1.0 if lat0 > 0 else -1.0
        rho = 2 * F.tan(math.pi / 4 - sign * phi / 2)
        return _point(radius * rho * F.sin(lam), -sign * radius * rho * F.cos(lam), valid & (sign * lat > -90))
    cosine = math.sin(p0) * F.sin(phi) + math.cos(p0) * F.cos(phi) * F.cos(lam)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    c = F.acos(clamped)
    k, ok = {
        "laea": (F.sqrt(2 / (1 + clamped)), clamped > -1 + 1e-12),
        "aeqd": (F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c)), c < math.pi - 1e-12),
        "ortho": (F.lit(1.0), c <= math.pi / 2 + 0.005),
    }[kind]
    x = k * F.cos(phi) * F.sin(lam)
    y = k * (math.cos(p0) * F.sin(phi) - math.sin(p0) * F.cos(phi) * F.cos(lam))
    return _point(radius * x, radius * y, valid & ok)


def inverse(kind: str, x: Column, y: Column, lon0: float = 0.0, lat0: float = 0.0, lat1: float = 0.0, lat2: float | None = None, radius: float = EARTH_RADIUS_M) -> Column:
    """The struct (x: longitude, y: latitude) in degrees; null outside the image of the sphere."""
    if kind == "geographic":
        return _point(longitude(x), y, F.abs(y) <= 90)
    x, y, p0 = x / radius, y / radius, math.radians(lat0)
    half_turn = math.pi + 1e-12  # a point further round is outside the map

    def lonlat(lam: Column, phi: Column, ok: Column) -> Column:
        return _point(longitude(F.degrees(lam) + lon0), F.degrees(phi), ok & (F.abs(lam) <= half_turn) & (F.abs(phi) <= math.pi / 2 + 1e-12))

    if kind == "eqc":
        return lonlat(x / math.cos(math.radians(lat1)), y + p0, F.lit(True))
    if kind == "merc":
        return lonlat(x, 2 * F.atan(F.exp(y)) - math.pi / 2, F.lit(True))
    if kind == "lcc":
        n, f, rho0 = _cone(lat1, lat1 if lat2 is None else lat2, lat0)
        sign = math.copysign(1.0, n)
        rho = sign * F.hypot(x, rho0 - y)
        pole = sign * math.pi / 2
        phi = F.when(rho == 0, pole).otherwise(2 * F.atan(F.pow(f / F.nullif(rho, F.lit(0.0)), F.lit(1 / n))) - math.pi / 2)
        return lonlat(F.atan2(sign * x, sign * (rho0 - y)) / n, phi, F.lit(True))
    rho = F.hypot(x, y)
    if kind == "stere":
        sign = 1.0 if lat0 > 0 else -1.0
        return lonlat(F.atan2(x, -sign * y), sign * (math.pi / 2 - 2 * F.atan(rho / 2)), F.lit(True))
    c, ok = {"laea": (2 * F.asin(F.least(F.lit(1.0), rho / 2)), rho < 2), "aeqd": (rho, rho < math.pi), "ortho": (F.asin(F.least(F.lit(1.0), rho)), rho <= 1)}[kind]
    up = F.cos(c) * math.sin(p0) + F.when(rho == 0, 0.0).otherwise(y * F.sin(c) * math.cos(p0) / rho)
    phi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))
    lam = F.atan2(x * F.sin(c), rho * math.cos(p0) * F.cos(c) - y * math.sin(p0) * F.sin(c))
    return lonlat(F.when(rho == 0, 0.0).otherwise(lam), phi, ok)
