import math
import random

import pytest
from pyspark.sql import functions as F

from terrachron.functions import geometry, numeric, text
from terrachron.operators import changes, hierarchy, intervals, quality, ranking, spatial, timeline


@pytest.fixture(scope="module")
def world(spark):
    cols = "object_id string, valid_from string, valid_to string, ord int"
    life = [("A", None, None, 1), ("C", None, None, 2), ("R", None, None, 3), ("B", "-0001", "0001", 4), ("B", "1910-01-02", "1920-03", 5)]
    shape = [("A", None, "1914-06", 1, "shape", 1), ("A", "1914-07", None, 2, "shape", 2), ("B", "1910-01-02", "1920-03", 3, "b", 1), ("C", None, None, 4, "c", 1), ("R", None, None, 5, "r", 1)]
    above = [("B", "1910-01-02", "1915", 1, "A"), ("B", "1916", "1920-03", 2, "C"), ("A", None, None, 3, "R")]
    names = [("B", "1910-01-02", "1915", 1, "name", "Earlier territory"), ("B", "1916", "1920-03", 2, "name", "Later territory")]
    make = lambda rows, more="": timeline.with_bounds(spark.createDataFrame(rows, cols + more))
    return make(life), make(shape, ", geom_id string, geom_version int"), make(above, ", parent_id string"), make(names, ", property string, value string")


def resolved(world, month):
    return {r.object_id: r for r in timeline.resolve_world(*world, month).collect()}


def test_world_at_month(world):
    assert resolved(world, "1914-06")["A"].geom_version == 1 and resolved(world, "1914-07")["A"].geom_version == 2
    b = resolved(world, "1915-12")["B"]
    assert (b.parent_id, b.name, b.ancestors, b.root_id) == ("A", "Earlier territory", ["A", "R"], "R")
    b = resolved(world, "1916-01")["B"]
    assert (b.parent_id, b.name, b.root_id) == ("C", "Later territory", "C")
    assert "B" in resolved(world, "1920-03") and "B" not in resolved(world, "1920-04")
    assert "B" not in resolved(world, "-0001-06")  # alive, but without a shape


def test_availability_and_edits(spark, world):
    ids = spark.createDataFrame([("A",), ("B",), ("X",)], "object_id string")
    state = lambda month: {r.object_id: r.state for r in timeline.availability(ids, world[0], world[1], month).collect()}
    assert state("-0001-06") == {"A": "Available", "B": "GeometryGap", "X": "Absent"}
    assert state("1930-01")["B"] == "Absent"
    halves = timeline.split_at(world[2].where("object_id = 'B' and ord = 1"), "1912-05").select("part", "lo", "hi").collect()
    assert {tuple(r) for r in halves} == {("before", 19100102, 19120430), ("after", 19120501, 19151231)}
    assert {tuple(r) for r in timeline.truncate_at(world[2].where("object_id = 'B'"), "1912-05").select("lo", "hi").collect()} == {(19100102, 19120430)}


def test_hierarchy(spark):
    rows = [("r", None, "k"), ("a", "r", "k"), ("b", "a", "k"), ("c", "b", "k"), ("x", "y", "k"), ("y", "x", "k"), ("m", "gone", "k"), ("r2", None, "k")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, kind string")
    got = {r.id: r for r in hierarchy.ancestors(nodes).collect()}
    assert got["c"].ancestors == ["b", "a", "r"] and got["c"].root_id == "r" and got["r"].root_id == "r"
    assert got["x"].state == got["y"].state == "Cycle" and got["m"].state == "Missing"
    assert {tuple(r) for r in hierarchy.descendants(nodes, "r").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in hierarchy.siblings(nodes).collect()} == {("r", "r2"), ("r2", "r")}


def test_ambiguous_and_islands(spark):
    rows = spark.createDataFrame([(1, 0, 5, 1), (1, 4, 9, 2), (1, 20, 30, 3), (2, 0, 1, 4)], "k int, lo int, hi int, ord int")
    assert [tuple(r) for r in intervals.ambiguous(rows, ["k"], F.lit(4).between(F.col("lo"), F.col("hi"))).collect()] == [(1, 2)]
    merged = intervals.coalesced(rows, ["k"], "lo", "hi", F.col("lo") <= F.col("_reach") + 1, ["ord"])
    assert {(r.k, r.lo, r.hi, r.n_rows) for r in merged.collect()} == {(1, 0, 9, 2), (1, 20, 30, 1), (2, 0, 1, 1)}
    assert [r.key for r in quality.overlaps(rows, ["k"], "lo", "hi", ["ord"], "o").collect()] == ["1|2"]


def test_boxes_join_matches_brute_force(spark):
    import random

    random.seed(5)
    box = lambda i, d: (i, *(lambda x, y: (x, y, x + random.random() * d, y + random.random() * d))(random.uniform(-170, 150), random.uniform(-80, 60)))
    a, b = [box(i, 3) for i in range(150)], [box(i, 8) for i in range(80)] + [(99, -180.0, -90.0, 180.0, 90.0)]
    schema = "id int, w double, s double, e double, n double"
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    got = [tuple(r) for r in spatial.boxes_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, v string")
    old, new = make([(1, "a"), (2, None), (3, "c")]), make([(2, "b"), (3, "c"), (4, None)])
    assert {tuple(r) for r in changes.revision_diff(old, new, ["id"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    assert {tuple(r) for r in changes.restore(old, make([(3, "z"), (9, "n")]), make([(1, "")]), "id").collect()} == {(2, None), (3, "z"), (9, "n")}


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)]))
    assert value(geometry.signed_area(ring)) == 2.0 and value(geometry.polygon_area(F.array(ring, ring))) == 0.0
    assert value(geometry.length_degrees(ring)) == 6.0 and abs(value(geometry.spherical_area_km2(ring)) - 24728) < 10
    assert [value(geometry.in_ring(F.lit(x), F.lit(0.5), ring)) for x in (1.0, 2.0, 3.0)] == [1, 2, 0]
    assert value(F.size(geometry.densify(ring, 0.5))) == 13
    assert [value(geometry.longitude(F.lit(x))) for x in (180.0, 190.0, -181.0)] == [-180.0, -170.0, 179.0]
    assert [value(geometry.longitude_closed(F.lit(x))) for x in (180.0, -180.0, 190.0)] == [180.0, -180.0, -170.0]
    assert [(b.w, b.e) for b in value(geometry.boxes(*(F.lit(float(x)) for x in (170, -5, 190, 5))))] == [(170.0, 180.0), (-180.0, -170.0)]
    assert [value(numeric.half_even(F.lit(x))) for x in (0.5, 1.5, -2.5)] == [0.0, 2.0, -2.0] and value(numeric.half_up(F.lit(-0.5))) == 0
    assert value(numeric.value_alpha(F.lit(5.0), F.lit(5.0), F.lit(5.0))) == pytest.approx(0.7) and value(numeric.value_alpha(F.lit(5.0), F.lit(None).cast("double"), F.lit(5.0))) == 0
    assert not value(text.finds(F.lit("abc"), " ")) and value(text.finds(F.lit("A  b c"), "B C"))
    assert value(text.label_width(F.lit("ab漢"), 1.0, 2.0)) == 4.0
    assert [value(ranking.stage(F.lit(x), [9, 5, 1])) for x in (10, 5, 0)] == [1, 2, None]


def test_neighbours_across_the_antimeridian_and_the_poles(spark):
    rng = random.Random(9)
    made = [(179.9, 0.0), (-179.9, 0.0), (180.0, 60.0), (-180.0, 60.5), (0.0, 90.0), (77.0, 89.5), (-103.0, 89.5), (10.0, -90.0), (170.0, -89.2), (-60.0, -89.9)]
    made += [(rng.choice([-1, 1]) * rng.uniform(177, 180), rng.uniform(-85, 85)) for _ in range(150)]
    made += [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(84, 90)) for _ in range(150)]

    def km(a, b):
        (x, y), (u, v) = ([math.radians(c) for c in p] for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 12742.016 * math.asin(min(1, math.sqrt(h)))

    for reach in (200.0, 220.0):
        want = {(i, j) for i, a in enumerate(made) for j, b in enumerate(made) if i != j and km(a, b) <= reach}
        got = [(r.id, r.other) for r in spatial.neighbours(spark.createDataFrame([(i, *p) for i, p in enumerate(made)], "id long, lon double, lat double"), reach).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {(0, 1), (2, 3), (5, 6), (7, 8)} <= want
