"""Where a label stands best: the point of a polygon that is furthest from its rings, holes included, within a stated precision.

A polygon is covered by square cells; no point of a cell is further from the rings than its middle by more than half its diagonal. Cells
that can't beat the best middle found by more than the precision are dropped, the others are quartered. All polygons of a
batch are searched together, a generation of cells at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Pairs of points and edges that are compared at once.
PAIRS = 1 << 21


def signed_distances(points: np.ndarray, of: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How far each point is from the edges of its polygon, negative outside (even-odd). edges (x1, y1, x2, y2) of polygon i: edges[starts[i]:starts[i + 1]]."""
    out = np.empty(len(points))
    sizes = np.diff(starts)[of]
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(points):
        last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS, side="right")) - 1)
        n = sizes[first:last]
        point = np.repeat(np.arange(first, last), n)
        begin = np.cumsum(n) - n
        e = edges[np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(starts[of[first:last]], n)]
        x, y = points[point].T
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        size = dx * dx + dy * dy
        t = np.clip(np.divide((x - e[:, 0]) * dx + (y - e[:, 1]) * dy, size, out=np.zeros(len(x)), where=size > 0), 0, 1)
        away = (x - e[:, 0] - t * dx) ** 2 + (y - e[:, 1] - t * dy) ** 2
        rises = (e[:, 1] > y) != (e[:, 3] > y)
        crossed = rises & (x < e[:, 0] + np.divide((y - e[:, 1]) * dx, dy, out=np.zeros(len(x)), where=rises))
        inside = np.add.reduceat(crossed, begin, dtype=np.int64) % 2 == 1
        out[first:last] = np.sqrt(np.minimum.reduceat(away, begin)) * np.where(inside, 1, -1)
        first = last
    return out


def furthest_points(edges: np.ndarray, starts: np.ndarray, precision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each polygon a point and its distance from the edges, at most `precision` below the greatest one. Each polygon has edges and an extent."""
    low = np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), starts[:-1], axis=0)
    high = np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), starts[:-1], axis=0)
    count = len(low)
    side = (high - low).min(axis=1)
    n = np.ceil((high - low) / side[:, None]).astype(np.int64).clip(1, 64)
    side = ((high - low) / n).max(axis=1)
    of = np.repeat(np.arange(count), n.prod(axis=1))
    place = np.arange(len(of)) - np.repeat(np.cumsum(n.prod(axis=1)) - n.prod(axis=1), n.prod(axis=1))
    middle = low[of] + (np.stack([place % n[of, 0], place // n[of, 0]], axis=1) + 0.5) * side[of, None]
    half = side[of] / 2
    best, at = np.full(count, -np.inf), (low + high) / 2
    best = signed_distances(at, np.arange(count), edges, starts)
    while len(of):
        away = signed_distances(middle, of, edges, starts)
        order = np.lexsort((-away, of))
        lead = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        better = lead[away[lead] > best[of[lead]]]
        best[of[better]], at[of[better]] = away[better], middle[better]
        go = away + half * np.sqrt(2) > best[of] + precision[of]
        of, middle, half = np.repeat(of[go], 4), np.repeat(middle[go], 4, axis=0), np.repeat(half[go] / 2, 4)
        middle = middle + np.tile([[-1, -1], [1, -1], [-1, 1], [1, 1]], (len(of) // 4, 1)) * half[:, None]
    return at, best


def label_anchor(polygon: Column, precision: float = 0.01) -> Column:
    """The struct (x, y, distance) of a list of closed rings (outer first; the rest count as holes): the point furthest from all of them.

    precision is a share of the polygon's shorter extent. Null for null, for a polygon without rings and for one without extent; rings of fewer than four corners don't count.
    """

    def run(polygons: pa.Array) -> pa.Array:
        edges, owner = [], []
        rings = polygons.flatten()
        ring_of = np.repeat(np.arange(len(polygons)), polygons.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        corners = rings.flatten()
        xy = np.stack([corners.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1) if len(corners) else np.zeros((0, 2))
        sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ring = np.repeat(np.arange(len(rings)), sizes)
        step = np.flatnonzero((ring[1:] == ring[:-1]) & (sizes[ring[:-1]] >= 4)) if len(ring) else np.zeros(0, np.int64)
        edges = np.concatenate([xy[step], xy[step + 1]], axis=1) if len(step) else np.zeros((0, 4))
        owner = ring_of[ring[step]] if len(step) else np.zeros(0, np.int64)
        out: list[dict | None] = [None] * len(polygons)
        some = np.unique(owner)
        if len(some):
            starts = np.r_[np.searchsorted(owner, some), len(owner)]
            ends = np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), starts[:-1], axis=0), np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), starts[:-1], axis=0)
            extent = (ends[1] - ends[0]).min(axis=1)
            real = extent > 0
            if real.any():
                keep = np.isin(owner, some[real])
                edges, owner, some = edges[keep], owner[keep], some[real]
                at, best = furthest_points(edges, np.r_[np.searchsorted(owner, some), len(owner)], extent[real] * precision)
                for i, (x, y), d in zip(some.tolist(), at.tolist(), best.tolist(), strict=True):
                    out[i] = {"x": x, "y": y, "distance": d}
        return pa.array(out, pa.struct([("x", pa.float64()), ("y", pa.float64()), ("distance", pa.float64())]))

    return F.arrow_udf(run, "struct<x:double,y:double,distance:double>")(polygon)
