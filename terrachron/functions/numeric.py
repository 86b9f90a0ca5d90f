"""Rounding families and measures as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Earth radii in metres and kilometres, and degrees to kilometres for short distances.
EARTH_RADIUS_M, EARTH_RADIUS_KM, RANK_DIAMETER_KM = 6_371_008.8, 6371.0088, 12742.016
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.57


def half_even(x: Column) -> Column:
    return F.rint(x)


def half_up(x: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(x + 0.5)


def micro(x: Column) -> Column:
    """Millionths, halves to even."""
    return F.rint(x * 1e6).cast("long")


def quantise(x: Column, step: Column | float) -> Column:
    """The nearest multiple of step, halves to even multiples, the sign kept."""
    return F.rint(F.abs(x) / step) * step * F.signum(x)


def percent_change(before: Column, after: Column) -> Column:
    return (after - before) / F.nullif(before, F.lit(0.0)) * 100


def log_error(ratio: Column) -> Column:
    return F.abs(F.ln(F.greatest(ratio, F.lit(1e-9))))


def _haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, diameter: float) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return diameter * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), h))))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return _haversine(lon1, lat1, lon2, lat2, 2 * EARTH_RADIUS_M)


def rank_distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return _haversine(lon1, lat1, lon2, lat2, RANK_DIAMETER_KM)


def local_distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x = (lon2 - lon1) * KM_PER_DEGREE_LON * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, (lat2 - lat1) * KM_PER_DEGREE_LAT)


def angular_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def value_alpha(value: Column, low: Column, high: Column) -> Column:
    """Opacity of a value in a range: 0.12 to 0.7; 0 without a range; the top where the range is one value."""
    span = high - low
    ratio = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span))).otherwise(1.0)
    return F.when(low.isNull() | high.isNull(), 0.0).otherwise(0.12 + 0.58 * ratio)


def exact_round(value: Column, digits: int) -> Column:
    """A double rounded to decimal digits by its exact binary value, ties to even; null for null and what isn't finite."""

    def rounded(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None or not math.isfinite(v) else round(v, digits) for v in values.to_pylist()], pa.float64())

    return F.arrow_udf(rounded, "double")(value)
