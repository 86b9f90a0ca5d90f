"""Runs along lines against points sampled densely, substrings against measures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import linear

LINES = "id long, points array<struct<x:double,y:double>>"


def path(rng, n, step):
    x = y = 0.0
    out = []
    for _ in range(n):
        out.append((x, y))
        x, y = x + rng.uniform(0, step), y + rng.uniform(-step, step)
    return out


def measures(line):
    return np.r_[0, np.cumsum([math.dist(a, b) for a, b in zip(line, line[1:], strict=False)])]


def place(line, m):
    ms = measures(line)
    i = min(max(int(np.searchsorted(ms, m, side="right")) - 1, 0), len(line) - 2)
    t = (m - ms[i]) / (ms[i + 1] - ms[i])
    return tuple(a + t * (b - a) for a, b in zip(line[i], line[i + 1], strict=True))


def beside(p, line, reach):
    """Within reach of a line, flat at its ends."""
    for i, (a, b) in enumerate(zip(line, line[1:], strict=False)):
        size = math.dist(a, b)
        s = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size
        n = ((p[1] - a[1]) * (b[0] - a[0]) - (p[0] - a[0]) * (b[1] - a[1])) / size
        if 0 <= s <= size and abs(n) <= reach:
            return True
        if i and math.dist(p, a) <= reach:
            return True
    return False


def test_runs_equal_sampled_points(spark):
    rng = random.Random(6)
    a = {i: path(rng, 12, 3) for i in range(5)}
    b = {10 + i: [(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for x, y in path(rng, 12, 3)] for i in range(4)} | {20: [(-50.0, 0.5), (80.0, 0.5)]}
    got = {}
    found = linear.runs_along(spark.createDataFrame(list(a.items()), LINES), spark.createDataFrame(list(b.items()), LINES), 1.5).collect()
    for r in found:
        got.setdefault((r.a, r.b), []).append((r.from_a, r.to_a, r.from_b, r.to_b))
    checked = 0
    for i, line in a.items():
        total = measures(line)[-1]
        for j, other in b.items():
            runs = got.get((i, j), [])
            assert all(x[1] < y[0] for x, y in zip(sorted(runs), sorted(runs)[1:], strict=False))
            for m in np.linspace(0, total, 400):
                edge = any(abs(m - e) < 1e-6 for r in runs for e in r[:2])
                inside = any(r[0] <= m <= r[1] for r in runs)
                assert edge or inside == beside(place(line, m), other, 1.5), (i, j, m)
                checked += inside
            for r in runs:  # both ends lie within reach of their places on the other line
                assert all(math.dist(place(line, r[k]), place(other, r[k + 2])) <= 1.5 + 1e-6 for k in (0, 1))
    assert checked > 300


def test_lines_are_put_onto_what_they_follow(spark):
    river = [(0.0, 5.0), (10.0, 0.5), (20.0, 0.5), (30.0, 5.0), (40.0, 5.0)]
    border = [(50.0, 0.0), (5.0, 0.0)]
    frames = [spark.createDataFrame([(i, p)], LINES) for i, p in ((1, river), (2, border))]
    rows = {r.no: r for r in linear.aligned(*frames, 1.0, 5.0).collect()}
    assert [rows[i].b for i in sorted(rows)] == [None, 2, None]
    assert all(p.y == 0 for p in rows[2].points) and rows[2].points[0].x < rows[2].points[-1].x
    assert tuple(rows[1].points[0]) == river[0] and tuple(rows[3].points[-1]) == river[-1]
    assert rows[1].points[-1].y == pytest.approx(1.0)
    none = linear.aligned(frames[0], spark.createDataFrame([(9, [(0.0, 90.0), (1.0, 90.0)]), (8, None), (7, [(0.0, 0.0)])], LINES), 1.0, 5.0).collect()
    assert [(r.no, r.b, len(r.points)) for r in none] == [(1, None, 5)]


def test_better_runs_win(spark):
    runs = [(1, 10, 1, 0.0, 10.0), (1, 11, 1, 8.0, 30.0), (1, 12, 1, 9.8, 12.0), (1, 13, 1, 29.7, 31.0), (2, 10, 1, 0.0, 1.0)]
    df = spark.createDataFrame(runs, "a long, b long, run_no int, from_a double, to_a double").withColumns({"from_b": F.lit(0.0), "to_b": F.lit(0.0)})
    assert sorted((r.a, r.b) for r in linear.accepted_runs(df).collect()) == [(1, 11), (1, 13), (2, 10)]


def test_substrings(spark):
    line = [(0.0, 0.0), (3.0, 0.0), (3.0, 0.0), (3.0, 4.0), (0.0, 4.0)]
    cuts = spark.createDataFrame([(1, 1, 1.0, 5.0), (1, 2, 5.0, 1.0), (1, 3, 0.0, 10.0), (1, 4, 3.0, 7.0)], "id long, no int, from_m double, to_m double")
    got = {r.no: [tuple(p) for p in r.points] for r in linear.substrings(spark.createDataFrame([(1, line)], LINES), cuts).collect()}
    assert got == {1: [(1, 0), (3, 0), (3, 2)], 2: [(3, 2), (3, 0), (1, 0)], 3: [(0, 0), (3, 0), (3, 4), (0, 4)], 4: [(3, 0), (3, 4)]}
