"""Label anchors against a fine grid, pixel runs against point tests, filled rasters against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import anchors, masks


def star(rng, cx, cy, n, r):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * d * math.cos(a), cy + r * d * math.sin(a)) for a, d in ((a, rng.uniform(0.3, 1)) for a in angles)]
    return [*ring, ring[0]]


def edges_of(polygon):
    return np.array([[*a, *b] for ring in polygon for a, b in zip(ring, ring[1:], strict=False)])


def polygons(rng):
    out = []
    for _ in range(14):
        rings = [star(rng, 0, 0, rng.randint(3, 30), 10)]
        if rng.random() < 0.5:
            rings.append(star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 6, 1.5))
        out.append(rings)
    out.append([[(0.0, 0.0), (100.0, 0.0), (100.0, 1.0), (0.0, 1.0), (0.0, 0.0)]])
    return out


def test_anchor_is_within_the_precision_of_a_fine_grid():
    found = polygons(random.Random(5))
    parts = [edges_of(p) for p in found]
    starts = np.r_[0, np.cumsum([len(p) for p in parts])]
    at, best = anchors.furthest_points(np.concatenate(parts), starts, np.full(len(parts), 0.02))
    for e, (x, y), d in zip(parts, at, best, strict=True):
        one = np.array([0, len(e)])
        assert anchors.signed_distances(np.array([[x, y]]), np.zeros(1, int), e, one)[0] == pytest.approx(d)
        low, high = e.reshape(-1, 2).min(0), e.reshape(-1, 2).max(0)
        grid = np.stack(np.meshgrid(*(np.linspace(a, b, 60) for a, b in zip(low, high, strict=True))), -1).reshape(-1, 2)
        assert anchors.signed_distances(grid, np.zeros(len(grid), int), e, one).max() <= d + 0.02


def test_anchor_column(spark):
    shape = "polygon array<array<struct<x:double,y:double>>>"
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.9, 1.0), (3.9, 3.9), (1.0, 3.9), (1.0, 1.0)]
    rows = [(1, [square]), (2, [square, hole]), (3, None), (4, []), (5, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]), (6, [[(0.0, 0.0)]])]
    got = {r.id: r.a for r in spark.createDataFrame(rows, f"id int, {shape}").select("id", anchors.label_anchor(F.col("polygon"), 0.001).alias("a")).collect()}
    assert (got[1].x, got[1].y, got[1].distance) == pytest.approx((2, 2, 2), abs=0.01)
    assert got[2].distance == pytest.approx(2 - math.sqrt(2), abs=0.01) or got[2].distance > 0.5
    assert [got[i] for i in (3, 4, 5, 6)] == [None] * 4


def test_pixel_runs_equal_point_tests(spark):
    rng = random.Random(7)
    shapes = {i: [star(rng, 10, 10, 9, 9)] + ([star(rng, 10, 10, 5, 2)] if i % 2 else []) for i in range(6)}
    df = spark.createDataFrame([(i, r) for i, rings in shapes.items() for r in rings] + [(99, None), (98, [(1.0, 1.0)])], "id int, ring array<struct<x:double,y:double>>")
    got = {(r.id, x, r.y) for r in masks.pixel_runs(df).collect() for x in range(r.x1, r.x2 + 1)}
    for i, rings in shapes.items():
        e = edges_of(rings)
        grid = np.array([(x + 0.5, y + 0.5) for x in range(-2, 24) for y in range(-2, 24)])
        inside = anchors.signed_distances(grid, np.zeros(len(grid), int), e, np.array([0, len(e)])) > 0
        assert {(x, y) for g, x, y in got if g == i} == {(int(x - 0.5), int(y - 0.5)) for (x, y), ok in zip(grid, inside, strict=True) if ok}


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0])
def test_filled_equals_all_pairs(spark, share):
    rng = random.Random(int(share * 100))
    w, h = 17, 23
    data = [(x, y, float(rng.randrange(1000)) if rng.random() < share else None) for x in range(w) for y in range(h)]
    known = [(x, y, v) for x, y, v in data if v is not None]
    got = {(r.x, r.y): r for r in masks.filled(spark.createDataFrame(data, "x int, y int, value double")).collect()}
    assert len(got) == w * h and known
    for x, y, _ in data:
        _, sy, sx, v = min(((x - a) ** 2 + (y - b) ** 2, b, a, v) for a, b, v in known)
        assert (got[x, y].sx, got[x, y].sy, got[x, y].value) == (sx, sy, v)


def test_filled_without_anything_known(spark):
    got = masks.filled(spark.createDataFrame([(0, 0, None), (1, 0, None)], "x int, y int, value double")).collect()
    assert [(r.value, r.sx) for r in got] == [(None, None)] * 2
