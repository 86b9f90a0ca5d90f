"""Simplified maps: neighbours fit, rings stay closed, areas change little."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from terrachron.operators import lod, overlay, shapes

RINGS = "gid long, owner long, hole boolean, ring array<struct<x:double,y:double>>"


def crooked_grid(rng, n, per):
    """Cells of a grid whose borders wander: each border is drawn once and used by both its neighbours."""
    border = {}

    def line(a, b):
        key = (min(a, b), max(a, b))
        if key not in border:
            (x1, y1), (x2, y2) = key
            inner = [(x1 + (x2 - x1) * t / per + rng.uniform(-0.05, 0.05), y1 + (y2 - y1) * t / per + rng.uniform(-0.05, 0.05)) for t in range(1, per)]
            border[key] = [(float(x1), float(y1)), *((round(x, 6), round(y, 6)) for x, y in inner), (float(x2), float(y2))]
        return border[key] if (a, b) == key else border[key][::-1]

    out = []
    for i in range(n):
        for j in range(n):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for k in range(4) for p in line(c[k], c[(k + 1) % 4])[:-1]]
            out.append((1, i * n + j, False, [*ring, ring[0]]))
    return out


def plain_kept(xy, tolerance):
    kept, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        best, far = -1.0, None
        for i in range(a + 1, b):
            d = xy[b] - xy[a]
            size = (d * d).sum()
            t = min(1, max(0, ((xy[i] - xy[a]) * d).sum() / size)) if size else 0
            off = math.hypot(*(xy[i] - xy[a] - t * d))
            if off > best:
                best, far = off, i
        if best > tolerance:
            kept.add(far)
            todo += [(a, far), (far, b)]
    return sorted(kept)


def test_many_lines_at_once_equal_one_by_one():
    rng = np.random.default_rng(1)
    lines = [np.cumsum(rng.normal(size=(n, 2)), axis=0) for n in (1, 2, 3, 40, 100, 7)] + [np.zeros((5, 2))]
    starts = np.r_[0, np.cumsum([len(x) for x in lines])]
    kept = lod.kept_corners(np.concatenate(lines), starts, 1.5, np.zeros(len(lines), int))
    for line, a, b in zip(lines, starts, starts[1:], strict=False):
        assert np.flatnonzero(kept[a:b]).tolist() == (plain_kept(line, 1.5) if len(line) > 1 else [0])
    forced = lod.kept_corners(np.concatenate(lines), starts, 1e9, np.full(len(lines), 2))
    assert [int(forced[a:b].sum()) for a, b in zip(starts, starts[1:], strict=False)] == [1, 2, 3, 4, 4, 4, 4]


def test_neighbours_still_fit(spark):
    data = crooked_grid(random.Random(3), 4, 12)
    # An island within a cell, and the lake that it fills.
    lake = [(1.4, 1.4), (1.6, 1.4), (1.61, 1.5), (1.6, 1.6), (1.4, 1.6), (1.4, 1.4)]
    data += [(1, 5, True, lake), (1, 99, False, lake), (2, 7, False, lake)]
    rings = spark.createDataFrame(data, RINGS)
    found = lod.simplified_map(rings, 0.06).cache()
    before = {(r.a, r.b): r.length for r in shapes.shared_borders(rings.where("gid = 1")).collect()}
    after = {(r.a, r.b): r.n for r in shapes.shared_borders(found.where("gid = 1")).collect()}
    assert before.keys() == after.keys()
    got = found.collect()
    assert all(r.ring[0] == r.ring[-1] and r.n >= 3 and len(set(map(tuple, r.ring[:-1]))) == r.n for r in got)
    area = {}
    for r in got:
        area[r.gid, r.owner] = area.get((r.gid, r.owner), 0) + r.area
    assert {k[1] for k in area if k[0] == 1} == set(range(16)) | {99} and (2, 7) in area
    assert sum(v for k, v in area.items() if k[0] == 1) > 15.5 and all(v > 0 for v in area.values())
    assert sum(r.n for r in got) < 0.5 * sum(len(d[3]) - 1 for d in data)
    # Nothing overlaps: the union has as much area as all owners together, and the edges meet at their ends only.
    edges = overlay.ring_edges(found.select("gid", F.lit("a").alias("side"), (F.col("area") < 0).alias("hole"), "ring"))
    pieces = found.select(F.struct("gid", "owner").alias("gid"), F.lit("a").alias("side"), (F.col("area") < 0).alias("hole"), "ring")
    distinct = overlay.ring_edges(pieces).select("gid.gid", *overlay.ENDS).distinct()
    assert overlay._cuts(distinct, overlay.CELL).count() == 0 and edges.count() > 0


def test_twins_and_needles_keep_their_area(spark):
    """Two owners on either side of a slightly bent line between the same two ends, and a needle that a coarse tolerance would close."""
    lens = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (5.0, -0.01), (0.0, 0.0)]
    top = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    found = lod.simplified_map(spark.createDataFrame([(1, 1, False, lens), (1, 2, False, top)], RINGS), 1.0).collect()
    areas = {r.owner: r.area for r in found}
    assert areas[1] > 0 and areas[2] > 0
    assert lod.simplified_map(spark.createDataFrame([], RINGS), 1.0).collect() == []
