"""Rings over the antimeridian and round the poles against the same rings turned away from it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrachron.operators import seam, shapes

RINGS = "id long, hole boolean, ring array<struct<x:double,y:double>>"


def wrap(x):
    return (x + 180) % 360 - 180


def star(rng, lon, lat, n, r):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(round(lon + r * d * math.cos(a), 6), round(lat + r * d * math.sin(a), 6)) for a, d in ((a, rng.uniform(0.4, 1)) for a in angles)]
    return [*ring, ring[0]]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_areas_and_points_do_not_depend_on_the_seam(spark):
    rng = random.Random(8)
    flat = {i: star(rng, rng.uniform(-30, 30), rng.uniform(-40, 40), 9, 25) for i in range(12)}
    turned = [(i, False, [(wrap(x + 180), y) for x, y in ring]) for i, ring in flat.items()]
    df = spark.createDataFrame(turned, RINGS)
    plain = spark.createDataFrame([(i, False, r) for i, r in flat.items()], RINGS)
    area = lambda d: {r.id: r.a for r in d.select("id", seam.spherical_area_km2(F.col("ring")).alias("a")).collect()}
    a, b = area(df), area(plain)
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in flat)
    cut = {}
    for r in seam.cut_at_seam(df).collect():
        cut[r.id] = cut.get(r.id, 0) + r.area
        assert all(-180 <= p.x <= 180 for ring in r.rings for p in ring)
    assert all(cut[i] == pytest.approx(abs(shoelace(flat[i])), abs=1e-3) for i in flat)
    probes = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in flat for _ in range(40)]
    asked = spark.createDataFrame([(i, wrap(x + 180), y, k) for k, (i, x, y) in enumerate(probes)], "id long, x double, y double, k long")
    got = {r.k: r.at for r in asked.join(df, "id").select("k", seam.located(F.col("x"), F.col("y"), F.col("ring")).alias("at")).collect()}
    assert all(got[k] == int(inside(x, y, flat[i])) for k, (i, x, y) in enumerate(probes))
    corner = df.select(seam.located(F.col("ring")[1]["x"], F.col("ring")[1]["y"], F.col("ring")).alias("at")).collect()
    assert {r.at for r in corner} == {2}


def test_poles_and_holes(spark):
    cap = [(float(wrap(x)), 60.0) for x in range(0, 360, 10)]
    south = [(float(wrap(-x)), -75.0) for x in range(5, 365, 10)]
    band = [(170.0, -10.0), (-170.0, -10.0), (-170.0, 10.0), (170.0, 10.0), (170.0, -10.0)]
    hole = [(178.0, -1.0), (-178.0, -1.0), (-178.0, 1.0), (178.0, 1.0), (178.0, -1.0)]
    df = spark.createDataFrame([(1, False, [*cap, cap[0]]), (2, False, [*south, south[0]]), (3, False, band), (3, True, hole), (4, False, None), (5, False, [])], RINGS)
    found = {}
    for r in seam.cut_at_seam(df).collect():
        found.setdefault(r.id, []).append(r)
    assert sum(r.area for r in found[1]) == pytest.approx(360 * 30) and sum(r.area for r in found[2]) == pytest.approx(360 * 15)
    assert sum(r.area for r in found[3]) == pytest.approx(20 * 20 - 4 * 2) and len(found[3]) == 2 and found.keys() == {1, 2, 3}
    at = df.where("id < 3").select("id", seam.turns_round(F.col("ring")).alias("t"), seam.spherical_area_km2(F.col("ring")).alias("a"), *(seam.located(F.lit(x), F.lit(y), F.col("ring")).alias(n) for n, x, y in (("north", 17.0, 85.0), ("middle", 17.0, 0.0), ("south", -170.0, -85.0)))).collect()
    got = {r.id: r for r in at}
    assert [abs(got[i].t) for i in (1, 2)] == [1, 1]
    assert (got[1].north, got[1].middle, got[1].south) == (1, 0, 0) and (got[2].north, got[2].middle, got[2].south) == (0, 0, 1)
    assert got[1].a == pytest.approx(2 * math.pi * 6371.0088**2 * (1 - math.sin(math.radians(60))), rel=0.02)
    boxes = df.where("id = 3 and not hole").select(seam.edge_boxes(F.col("ring")).alias("b")).first().b
    assert len(boxes) == 6 and all(-180 <= b.w <= b.e <= 180 for b in boxes)
    one = df.where("id = 3").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("hole", "ring"))).alias("r")).select(seam.spherical_polygon_km2(F.transform("r", lambda x: x["ring"])).alias("a"), seam.spherical_area_km2(F.col("r")[0]["ring"]).alias("o")).first()
    assert 0.95 < one.a / one.o < 0.99


def test_refined_rings_share_whole_edges(spark):
    wide = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    cells = [[(float(x), 2.0), (x + 1.0, 2.0), (x + 1.0, 3.0), (float(x), 3.0), (float(x), 2.0)] for x in range(4)]
    rings = spark.createDataFrame([(1, 0, False, wide), *((1, 1 + i, False, c) for i, c in enumerate(cells))], "gid long, owner long, hole boolean, ring array<struct<x:double,y:double>>")
    found = seam.refined(rings)
    rows = {r.owner: r for r in found.collect()}
    assert rows[0].n == 7 and rows[0].area == 8 and all(rows[i].area == 1 for i in range(1, 5))
    shared = {(r.a, r.b): r.length for r in shapes.shared_borders(found).collect()}
    assert shared == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1}
