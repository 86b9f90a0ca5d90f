import math
import random

from pyspark.sql import functions as F

from terrachron.functions import segments
from terrachron.operators import calibration, graph, matching, terrain
from terrachron.registry import QUERIES


def test_nearest_segment_is_that_of_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-1, 1), 1.0) for i in range(60)]
    lines = [(i, *(rng.uniform(-9, 9) for _ in range(4))) for i in range(25)] + [(99, 0.0, 0.0, 0.0, 0.0)]

    def distance(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        size = dx * dx + dy * dy
        t = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / size)) if size else 0
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    def cos(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        size = math.hypot(dx, dy) * math.hypot(p[3], p[4])
        return abs(p[3] * dx + p[4] * dy) / size if size else 0

    a = spark.createDataFrame(points, "id int, x double, y double, dx double, dy double")
    b = spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double")
    for least in (None, 0.55):
        want = {}
        for p in points:
            near = [(distance(p, s), s[0]) for s in lines if distance(p, s) <= 0.7 and (least is None or cos(p, s) >= least)]
            if near:
                want[p[0]] = min(near)[1]
        assert {r.id: r.segment for r in matching.nearest_segment(a, b, 0.7, least).collect()} == want


def test_winners_plans_and_references(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.9), (2, 2, 0.5), (2, 1, 0.9), (3, 1, 0.1)], "a int, b int, s double")
    assert sorted(map(tuple, matching.clear_winners(pairs, "a", "b", "s", 0.15).collect())) == [(2, 1, 0.9), (3, 1, 0.1)]
    new, old = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(3, 0), (3, 5), (4, 1)], "k int, i int")
    assert sorted(map(tuple, matching.merge_plan(new, old, "k", "i").collect())) == [(1, "insert", None), (2, "invalid", None), (3, "update", 5), (4, "keep", 1)]
    active = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), (None, 3)], "g string, v int")
    assert [tuple(r) for r in matching.missing_references(active, active.where("v = 1"), ["g", "v"]).collect()] == [("g", 2)]
    assert matching.users(active, ["g"], "v").count() == 3


def test_fragments_and_combined_rows(spark):
    rows = spark.createDataFrame([("a", 1, 2, [3]), ("a", 0, 2, [1, 2]), ("b", 0, 2, [1]), ("c", 0, 1, [1]), ("c", 0, 1, [2]), ("d", 1, 1, [1])], "k string, i int, n int, l array<int>")
    assert [tuple(r) for r in matching.whole_fragments(rows, "k", "i", "n", "l").collect()] == [("a", [1, 2, 3])]
    own, built = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 9), ("z", 8)], "k string, v int")
    assert [tuple(r) for r in matching.combined_rows([(own, 100), (built, 50)], "k", ["k"], 2).collect()] == [("x", 1, 0), ("y", 9, 0)]


def test_connected(spark):
    nodes = spark.range(1, 40).toDF("id")
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 19)] + [(30, 25), (25, 21), (21, 21), (38, 99)], "a long, b long")
    got = {r.id: r.component for r in graph.connected(nodes, links).collect()}
    assert got == {i: 1 if i < 20 else 21 if i in (21, 25, 30) else i for i in range(1, 40)}
    assert graph.is_connected(nodes.where("id < 20"), links).first() == (19, 1, True)


def test_segments(spark):
    row = spark.range(1).select(
        segments.clip_segment(*(F.lit(float(v)) for v in (-2, 0, 2, 0, -1, -1, 1, 1))).alias("cut"), segments.clip_segment(*(F.lit(float(v)) for v in (-2, 3, 2, 3, -1, -1, 1, 1))).alias("out"),
        segments.quantised_node(F.lit(180.0)).alias("node"), segments.delta_decoded(F.lit(5).cast("long"), F.array(F.lit(1), F.lit(-3))).alias("decoded"),
    ).first()
    assert tuple(row.cut) == (-1.0, 0.0, 1.0, 0.0, True, True) and row.out is None and row.node == -1_800_000_000 and row.decoded == [5, 6, 3]
    rings = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],), ([],), (None,)], "r array<struct<x:double,y:double>>")
    cleaned = [r[0] and [tuple(p) for p in r[0]] for r in rings.select(segments.clean_ring(F.col("r"))).collect()]
    assert cleaned == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [], None]
    assert rings.select(segments.distinct_vertices(F.col("r"))).first()[0] == 3
    lines = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 3.0)]],)], "l array<array<struct<x:double,y:double>>>")
    assert lines.select(segments.longest_part(F.col("l"))).first()[0] == 1


def test_gutters_wrap_and_clamp(spark):
    width, height, tile = 8, 4, 4
    pixels = spark.createDataFrame([(x, y, 10 * y + x) for x in range(width) for y in range(height)], "x int, y int, value int")
    got = {(r.tx, r.ty, r.px, r.py): r.value for r in terrain.with_gutters(pixels, width, height, tile).collect()}
    want = {(t, 0, p, q): 10 * max(0, min(height - 1, q)) + (t * tile + p) % width for t in range(2) for p in range(-1, 5) for q in range(-1, 5)}
    assert got == want and terrain.with_gutters(pixels, width, height, tile).count() == len(want)


def test_levels_and_tiles(spark):
    levels = spark.createDataFrame([(0, 100), (1, 200), (2, 400)], "level int, width int")
    assert tuple(terrain.level_for(levels, F.lit(150)).first()) == (1, False) and tuple(terrain.level_for(levels, F.lit(900)).first()) == (2, True)
    tiles = spark.createDataFrame([(0, 10), (1, 30), (1, 30), (2, 500)], "level int, bytes int")
    assert terrain.level_within(tiles, 2, 20, 90).first()[0] == 1 and terrain.level_within(tiles, 2, 200, 90).first()[0] is None
    box = "id string, level int, w double, s double, e double, n double"
    target = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 1.0), ("b", 1, 1.0, 0.0, 2.0, 1.0)], box)
    ready = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 1.0), ("c", 0, 0.0, 0.0, 4.0, 4.0), ("d", 2, 0.0, 0.0, 0.5, 0.5)], box)
    assert sorted((r.id, r.fallback) for r in terrain.ready_or_fallback(target, ready).collect()) == [("a", False), ("c", True)]
    assert spark.range(1).select(terrain.size_class(F.lit(257), F.lit(256)), terrain.zoom_threshold(F.lit(2.0))).first()[0] == "2x1"


def test_acceptance(spark):
    rows = spark.createDataFrame([("a", 1.1), ("a", 0.9), ("b", 1.2), ("c", None)], "k string, r double")
    got = {r.k: r.ok for r in rows.groupBy("k").agg(calibration.accepted(F.col("r"), 0.15).alias("ok")).collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert float(rows.agg(calibration.exact_sum(F.col("r"), 2)).first()[0]) == 3.2


def test_box_join_of_all_boxes(spark, tmp_path):
    """Each row's box is joined, whatever its id."""
    rows = [(i, [i * 0.002 - 0.05, (i % 7) * 0.003]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {i: (round(x * 300, 3), round(y * 150, 3)) for i, (x, y) in rows}
    want = {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if u - 1 <= x <= u + 1 and v - 1 <= y <= v + 1}
    got = [tuple(r) for r in QUERIES["q44_box_join_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {b for _, b in got} == set(at)
