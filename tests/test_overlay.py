"""Overlays, faces, rings and lines against plain versions, one pair or node at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import overlay as ov
from terrachron.operators.walks import walks

RINGS = "gid long, side string, hole boolean, ring array<struct<x:double,y:double>>"


def closed(points):
    points = [(float(x), float(y)) for x, y in points]
    return [*points, points[0]]


def star(rng, cx, cy, n, r):
    """An irregular ring: corners at rising angles, random distances."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return closed([(round(cx + r * d * math.cos(a), 6), round(cy + r * d * math.sin(a), 6)) for a, d in ((a, rng.uniform(0.3, 1)) for a in angles)])


def crossings_sorted_area(a, b, rule):
    """Area under a rule by vertical strips between all events: in each strip the edges don't cross, so parts are trapezia."""
    edges = [(s, p, q) for s, rings in (("a", a), ("b", b)) for ring in rings for p, q in zip(ring, ring[1:], strict=False)]
    xs = {x for _, p, q in edges for x in (p[0], q[0])}
    for i, (_, p, q) in enumerate(edges):
        for _, r, s in edges[:i]:
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 <= t <= 1:
                    xs.add(p[0] + t * (q[0] - p[0]))
    xs, total = sorted(xs), 0.0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        if x1 - x0 < 1e-12:
            continue
        mid, cut = (x0 + x1) / 2, []
        for s, p, q in edges:
            if p[0] != q[0] and min(p[0], q[0]) < mid < max(p[0], q[0]):
                y = p[1] + (mid - p[0]) / (q[0] - p[0]) * (q[1] - p[1])
                cut.append((y, s, 1 if p[0] < q[0] else -1))
        cut.sort()
        w = {"a": 0, "b": 0}
        for (y, s, d), (y2, _, _) in zip(cut, cut[1:] + [(math.inf, "", 0)], strict=True):
            w[s] += d
            inside = {"union": w["a"] or w["b"], "intersection": w["a"] and w["b"], "difference": w["a"] and not w["b"], "xor": bool(w["a"]) != bool(w["b"])}[rule]
            if inside and y2 < math.inf:
                total += (y2 - y) * (x1 - x0)
    return total


def rows(gid, side, rings, holes=()):
    return [(gid, side, False, r) for r in rings] + [(gid, side, True, r) for r in holes]


def areas_of(spark, data, rules=("union", "intersection", "difference", "xor")):
    pieces = ov.overlay(spark.createDataFrame(data, RINGS), list(rules))
    return pieces, {(r.gid, r.rule): r.area for r in ov.areas(pieces, ["gid", "rule"]).collect()}


def test_irregular_rings_equal_strips(spark):
    rng = random.Random(4)
    data, sets = [], {}
    for gid in range(12):
        a = [star(rng, 0, 0, rng.randint(3, 12), 3)]
        b = [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.randint(3, 12), 3) for _ in range(rng.randint(1, 2))]
        sets[gid] = (a, b)
        data += rows(gid, "a", [r if rng.random() < 0.5 else r[::-1] for r in a]) + rows(gid, "b", b)
    pieces, got = areas_of(spark, data)
    for gid, (a, b) in sets.items():
        for rule in ov.RULES:
            assert got.get((gid, rule), 0) == pytest.approx(crossings_sorted_area(a, b, rule), abs=2e-5), (gid, rule)
    found = ov.walked(pieces, ["gid", "rule"])
    summed = {(r.gid, r.rule): r.area for r in found.groupBy("gid", "rule").agg(F.sum("area").alias("area")).collect()}
    assert summed.keys() == got.keys() and all(summed[k] == pytest.approx(got[k], abs=1e-9) for k in got)
    for r in found.collect():
        assert r.ring[0] == r.ring[-1] and len(r.ring) == r.n + 1
    whole = {(r.gid, r.rule): r.area for r in ov.polygons(pieces, ["gid", "rule"]).groupBy("gid", "rule").agg(F.sum("area").alias("area")).collect()}
    assert all(whole[k] == pytest.approx(got[k], abs=1e-9) for k in got)


def square(x, y, w, h=None):
    h = w if h is None else h
    return closed([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])


def test_touching_equal_nested_and_empty(spark):
    far = square(100, 100, 1)
    cases = {
        1: (square(0, 0, 2), square(2, 0, 2), (8, 0, 4, 8)),  # a whole edge in common
        2: (square(0, 0, 2), square(2, 0.5, 2, 1), (6, 0, 4, 6)),  # a part of an edge
        3: (square(0, 0, 2), square(0, 0, 2), (4, 4, 0, 0)),  # equal
        4: (square(0, 0, 4), square(1, 1, 2), (16, 4, 12, 12)),  # a hole appears
        5: (square(0, 0, 2), square(2, 2, 2), (8, 0, 4, 8)),  # a corner in common
        6: (square(0, 0, 2), far, (5, 0, 4, 5)),
        7: (square(0, 0, 4), square(0, 1, 4, 2), (16, 8, 8, 8)),  # falls apart in two
    }
    data = [row for gid, (a, b, _) in cases.items() for row in rows(gid, "a", [a]) + rows(gid, "b", [b])]
    data += [(8, "a", False, None), (9, "a", False, []), (9, "b", False, [(1.0, 1.0)]), (10, "a", None, square(0, 0, 1)), (10, "b", False, [(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]), (10, "b", False, [(0.5, 0.0), (0.5, 0.5), (1.0, 0.5), (1.0, 0.0)])]
    pieces, got = areas_of(spark, data)
    for gid, (_, _, expected) in cases.items():
        assert tuple(got.get((gid, r), 0) for r in ("union", "intersection", "difference", "xor")) == expected, gid
    assert not any(g in (8, 9) for g, _ in got)
    assert got[10, "difference"] == 0.75  # an open ring is closed, a spike cancels
    shapes = {(r.gid, r.rule): sorted(len(x) for x in r.rings) for r in ov.polygons(pieces, ["gid", "rule"]).where("gid in (4, 5)").collect()}
    assert shapes[4, "difference"] == [5, 5]
    parts = {r.gid: r.n for r in ov.polygons(pieces.where("rule = 'difference'"), ["gid"]).groupBy("gid").agg(F.count("*").alias("n")).collect()}
    assert parts == {1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 7: 2, 10: 1}


def test_holes_find_their_polygon(spark):
    nested = [square(0, 0, 20), square(6, 6, 8)]
    holes = [square(1, 1, 2), square(4, 4, 12), square(7, 7, 1), square(10, 7, 2), square(10, 10, 2)]
    data = rows(1, "a", nested[:1], [holes[0], holes[1]]) + rows(1, "a", nested[1:], holes[2:])
    pieces = ov.overlay(spark.createDataFrame(data, RINGS), "union")
    found = sorted((r.area, len(r.rings)) for r in ov.polygons(pieces, ["gid"]).collect())
    assert found == [(64 - 1 - 4 - 4, 4), (400 - 4 - 144, 3)]
    # A hole that touches the outer ring at its least corner.
    diamond = closed([(0, 5), (5, 0), (10, 5), (5, 10)])
    inner = closed([(0, 5), (5, 4), (5, 6)])
    pieces = ov.overlay(spark.createDataFrame(rows(2, "a", [diamond]) + rows(2, "b", [inner]), RINGS), "difference")
    assert sum(r.area for r in ov.polygons(pieces, ["gid"]).collect()) == 45


def test_faces_and_euler(spark):
    rng = random.Random(9)
    data = [(1, "a", False, star(rng, rng.uniform(0, 6), rng.uniform(0, 6), 6, 2)) for _ in range(8)]
    pieces = ov.arranged(ov.ring_edges(spark.createDataFrame(data, RINGS)))
    e = pieces.count()
    v = pieces.select("x1", "y1").union(pieces.select("x2", "y2")).distinct().count()
    found = ov.faces(pieces).collect()
    outer = [f for f in found if f.area <= 0]
    inner = [f for f in found if f.area > 0]
    assert v - e + len(inner) == len(outer)  # as many connected parts as outer rings
    assert sum(f.area for f in found) == pytest.approx(0, abs=1e-9)
    # The pieces meet at their ends only.
    p = pieces.collect()
    for i, a in enumerate(p):
        for b in p[:i]:
            o = [(a.x2 - a.x1) * (y - a.y1) - (a.y2 - a.y1) * (x - a.x1) for x, y in ((b.x1, b.y1), (b.x2, b.y2))]
            q = [(b.x2 - b.x1) * (y - b.y1) - (b.y2 - b.y1) * (x - b.x1) for x, y in ((a.x1, a.y1), (a.x2, a.y2))]
            assert not (o[0] * o[1] < 0 and q[0] * q[1] < 0)


def plain_chains(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, out = {frozenset(e) for e in edges}, []

    def walk(a, b):
        line = [a, b]
        left.discard(frozenset((a, b)))
        while len(near[line[-1]]) == 2:
            nxt = [n for n in near[line[-1]] if frozenset((line[-1], n)) in left]
            if not nxt:
                break
            left.discard(frozenset((line[-1], nxt[0])))
            line.append(nxt[0])
        return line

    for a in sorted(near):
        if len(near[a]) != 2:
            for b in sorted(near[a]):
                if frozenset((a, b)) in left:
                    out.append(walk(a, b))
    for a in sorted(near):
        for b in sorted(near[a]):
            if frozenset((a, b)) in left:
                out.append(walk(a, b))
    return sorted(out)


def test_chains_equal_a_walk(spark):
    rng = random.Random(2)
    sets = {
        1: [((i, 0), (i + 1, 0)) for i in range(9)],
        2: [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))],
        3: [((0, 0), (1, 0)), ((1, 0), (2, 1)), ((2, 1), (2, -1)), ((2, -1), (1, 0)), ((0, 0), (0, 5))],
    }
    nodes = [(x, y) for x in range(6) for y in range(6)]
    sets[4] = sorted({tuple(sorted((a, b))) for a in nodes for b in nodes if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 and rng.random() < 0.6})
    data = [(g, a[0], a[1], b[0], b[1]) for g, edges in sets.items() for a, b in edges for _ in range(rng.randint(1, 2))]
    found = ov.chains(spark.createDataFrame(data, "gid long, x1 long, y1 long, x2 long, y2 long"), 1).collect()
    for g, edges in sets.items():
        lines = sorted([(int(p.x), int(p.y)) for p in r.points] for r in found if r.gid == g)
        assert lines == plain_chains(edges), g
    assert all(r.n == len(r.points) - 1 and r.closed == (r.points[0] == r.points[-1]) for r in found)


def test_walks(spark):
    links = [(i, i + 1 if i % 50 != 49 else None) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(5000, 5000), (6000, 7777), (None, 3)]
    found = {r.id: (r.cyclic, r.head, r.offset) for r in walks(spark.createDataFrame(links, "id long, next long")).collect()}
    for i in range(200):
        assert found[i] == (False, i // 50 * 50 + 49, 49 - i % 50)
    for i in range(37):
        assert found[1000 + i] == (True, 1000, (37 - i) % 37)
    assert found[5000] == (True, 5000, 0) and found[6000] == (False, 6000, 0) and len(found) == 239
    assert walks(spark.createDataFrame([], "id long, next long")).collect() == []


def test_straight_corners_go(spark):
    ring = closed([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0), (0.0, 2.0)])
    df = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    assert [tuple(p) for p in df.select(ov.without_straight(F.col("ring"))).first()[0]] == closed([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])


def test_random_crossing_lines_settle(spark):
    """Rounded crossings make new ones; splitting goes on until none is left."""
    rng = np.random.default_rng(3)
    p = rng.integers(-40, 40, (60, 4))
    data = [(1, *map(int, sorted([(a, b), (c, d)])[0]), *map(int, sorted([(a, b), (c, d)])[1]), 1, 0) for a, b, c, d in p if (a, b) != (c, d)]
    edges = ov.net(spark.createDataFrame(data, "gid long, x1 long, y1 long, x2 long, y2 long, a long, b long"))
    pieces = ov.arranged(edges, 4)
    assert ov._cuts(pieces, 4).count() == 0 and pieces.count() > 300
