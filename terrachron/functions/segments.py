"""Segments and vertices of lines and rings as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from terrachron.functions.geometry import line_km


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """The part of a segment in a box, as a struct with `cut_start` and `cut_end` for ends that aren't the segment's own; null outside."""
    dx, dy = x2 - x1, y2 - y1
    sides = [(-dx, x1 - w), (dx, e - x1), (-dy, y1 - s), (dy, n - y1)]
    start = F.greatest(F.lit(0.0), *(F.when(p < 0, q / p) for p, q in sides))
    end = F.least(F.lit(1.0), *(F.when(p > 0, q / p) for p, q in sides))
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    part = F.struct(
        (x1 + start * dx).alias("x1"), (y1 + start * dy).alias("y1"), (x1 + end * dx).alias("x2"), (y1 + end * dy).alias("y2"),
        (start > 0).alias("cut_start"), (end < 1).alias("cut_end"),
    )
    return F.when(~outside & (start <= end), part)


def clean_ring(ring: Column, apart: float = 1e-10) -> Column:
    """A closed ring without vertices that repeat the one before them; null and empty stay as they are."""
    def far(p: Column, q: Column) -> Column:
        return (F.abs(p["x"] - q["x"]) > apart) | (F.abs(p["y"] - q["y"]) > apart)

    kept = F.filter(ring, lambda p, i: (i == 0) | far(p, F.get(ring, F.greatest(i - 1, F.lit(0)))))
    first, last = F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1)
    return F.when(F.size(kept) < 1, kept).when(far(first, last), F.concat(kept, F.array(first))).otherwise(kept)


def distinct_vertices(ring: Column, digits: int = 8) -> Column:
    """How many different vertices a ring has on the grid of so many decimals."""
    return F.size(F.array_distinct(F.transform(ring, lambda p: F.struct(F.round(p["x"], digits), F.round(p["y"], digits)))))


def longest_part(lines: Column) -> Column:
    """The index, from 0, of the longest of several lines, the first on ties; null without lines."""
    lengths = F.transform(lines, line_km)
    return F.when(F.size(lines) > 0, F.array_position(lengths, F.array_max(lengths)).cast("int") - 1)


def quantised_node(x: Column, digits: int = 7) -> Column:
    """A coordinate as a whole number of steps, halves upwards; the meridian 180 is -180."""
    step = 10**digits
    q = F.floor(x * step + 0.5)
    return F.when(q == 180 * step, F.lit(-180 * step).cast("long")).otherwise(q)


def _running(starts: pa.Array, steps: pa.Array) -> pa.Array:
    flat = steps.flatten().to_numpy(zero_copy_only=False)
    sizes = steps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros(len(flat) + len(sizes), np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(len(out), bool)
    inside[first] = False
    out[inside] = flat
    sums = np.cumsum(out)
    sums += np.repeat(starts.fill_null(0).to_numpy(zero_copy_only=False) - sums[first], sizes + 1)
    ends = pa.array(np.concatenate([first, [len(out)]]), pa.int32(), mask=np.append(~(starts.is_valid().to_numpy(zero_copy_only=False) & steps.is_valid().to_numpy(zero_copy_only=False)), False))
    return pa.ListArray.from_arrays(ends, pa.array(sums))


def delta_decoded(start: Column, steps: Column) -> Column:
    """An array of values from its first one and the differences that follow: running sums, one vector for each batch; null if a side is."""
    return F.arrow_udf(_running, "array<long>")(start.cast("long"), steps.cast("array<long>"))
