"""Rival claims, replacements, children of changed parents, refused areas, slivers."""

from terrachron.operators import territories

SHAPES = "id long, hole boolean, ring array<struct<x:double,y:double>>"


def box(x, y, w, h):
    p = [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]
    return [*p, p[0]]


def areas(shapes):
    return {r.id: round(r.area, 6) for r in territories.shape_areas(shapes).collect()}


def test_replacements_rivals_and_children(spark):
    data = [
        (1, False, box(0, 0, 10, 10)), (2, False, box(8, 0, 4, 10)),  # 2 takes what 1 has of it; 1's child 3 is cut, its child 4 loses all
        (3, False, box(5, 0, 5, 5)), (4, False, box(8.5, 1, 1, 1)),
        (5, False, box(20, 0, 4, 4)), (6, False, box(22, 0, 4, 4)), (7, False, box(23, 1, 1, 1)),  # three rivals; 7 has nothing left
        (8, False, box(20, 0, 1, 4)),  # another parent's: no rival
    ]
    rows = [(1, None, False), (2, None, False), (3, 1, False), (4, 3, False), (5, 50, False), (6, 50, False), (7, 50, False), (8, 51, False)]
    shapes, log = territories.adjusted(spark.createDataFrame(rows, "id long, parent long, snapshot boolean"), spark.createDataFrame(data, SHAPES), 4.0, [(1, 2), (1, 99)])
    assert areas(shapes) == {1: 80, 2: 40, 3: 15, 5: 8, 6: 8, 8: 4}
    assert sorted((r.id, r.kind, r.related) for r in log.collect()) == [
        (1, "explicit-replacement", ["2"]), (3, "parent-clipping", ["1"]), (4, "empty-after-adjustment", ["3"]),
        (5, "unknown-peer-overlap", ["6", "7"]), (6, "unknown-peer-overlap", ["5", "7"]), (7, "empty-after-adjustment", ["5", "6"]),
    ]


def test_nothing_to_adjust(spark):
    shapes, log = territories.adjusted(spark.createDataFrame([(1, None, True), (2, None, True)], "id long, parent long, snapshot boolean"), spark.createDataFrame([(1, False, box(0, 0, 2, 2)), (2, False, box(1, 0, 2, 2))], SHAPES), 4.0)
    assert areas(shapes) == {1: 4, 2: 4} and log.collect() == []
    assert territories.overlapping(spark.createDataFrame([], SHAPES), 1.0).collect() == []


def test_waves_keep_the_order_of_dependent_rules():
    assert territories._waves([("b", "a"), ("c", "b"), ("d", "x"), ("b", "a")]) == [[("b", "a")], [("c", "b"), ("d", "x")]]


def test_slivers_go_up_to_a_total(spark):
    rows = [(1, i, a) for i, a in enumerate((0.5, 0.9, 0.8, 100.0))] + [(2, 0, 0.2), (3, 0, 5.0)]
    kept = territories.without_slivers(spark.createDataFrame(rows, "gid long, polygon_id long, area double"), ["gid"], 1.0, 1.5)
    assert sorted((r.gid, r.area) for r in kept.collect()) == [(1, 0.9), (1, 100.0), (3, 5.0)]


def test_components_keep_their_place(spark):
    parts = spark.createDataFrame([(1, 0, False, box(0, 0, 4, 4)), (1, 0, True, box(1, 1, 1, 1)), (1, 1, False, box(50, 0, 4, 4))], "id long, component int, hole boolean, ring array<struct<x:double,y:double>>")
    cutters = spark.createDataFrame([(9, False, box(2, -1, 1, 6)), (10, False, box(54, 0, 4, 4))], SHAPES)
    found = territories.component_difference(parts, cutters, 2.0).collect()
    assert sorted((r.component, round(r.area, 6)) for r in found) == [(0, 4.0), (0, 7.0), (1, 16.0)]
