"""Deep and circular hierarchies, maps' rims, search texts, days before, and texts of shapes."""

import math

import pytest
from pyspark.sql import functions as F

from terrachron.functions import projection, segments, temporal, text
from terrachron.operators import edits, hierarchy, labels, matching, rivers, shapes


def test_a_chain_and_a_cycle_beyond_64_levels(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 150) for i in range(150)] + [(5000, 1003)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long")
    got = {r.id: r for r in hierarchy.roots(nodes).collect()}
    assert all((got[i].root_id, got[i].steps, got[i].state) == (0, i, "Valid") for i in range(200))
    assert all(got[i].state == "Cycle" and got[i].root_id is None for i in [*range(1000, 1150), 5000])
    lines = {r.id: r for r in hierarchy.ancestors(nodes).collect()}
    assert lines[199].ancestors == list(range(198, -1, -1)) and lines[1000].ancestors is None
    most = {r.id: r.v for r in hierarchy.propagate_max(nodes.withColumn("v", F.col("id")), "v").collect()}
    assert most == {i: 199 for i in range(200)}
    wide = rivers.widths_downstream(nodes.select("id", F.col("parent_id").alias("next_id"), F.col("id").cast("double").alias("width")))
    assert wide.where("width = 199").count() == 200
    assert hierarchy.roots(nodes.limit(0)).count() == 0


def test_a_move_into_a_long_cycle_is_refused(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id long, parent_id long")
    kept, refused = edits.reparented(nodes, spark.createDataFrame([(0, 99)], "id long, parent_id long"))
    assert [tuple(r) for r in refused.collect()] == [(0, "cycle")] and kept.where("id = 0 and parent_id is null").count() == 1


@pytest.mark.parametrize(("kind", "x", "y"), [("eqc", 3.5, 0.1), ("merc", 3.5, 0.1), ("laea", 2.0, 0.0), ("aeqd", math.pi, 0.0), ("ortho", 1.1, 0.0)])
def test_points_off_the_map_are_null(spark, kind, x, y):
    found = projection.inverse(kind, F.col("x"), F.col("y"), radius=1.0)
    assert spark.createDataFrame([(x, y)], "x double, y double").select(found.alias("p")).first().p is None


def test_the_pole_of_a_cone(spark):
    there = projection.forward("lcc", F.lit(0.0), F.lit(89.999999), lat1=45.0, lat0=40.0, radius=1.0)
    y = spark.range(1).select(there["y"].alias("y")).first().y
    back = spark.createDataFrame([(0.0, y)], "x double, y double").select(projection.inverse("lcc", F.col("x"), F.col("y"), lat1=45.0, lat0=40.0, radius=1.0).alias("p")).first().p
    assert back.y == pytest.approx(89.999999, abs=1e-6)


def test_search_texts(spark):
    row = spark.createDataFrame([("\tRed   wing ", "ﬁnd Ⅻ")], "a string, b string")
    found = row.select(text.starts(F.col("a"), "red w").alias("s"), text.search_text(F.col("a")).alias("t"), text.place_query(F.col("b")).alias("q")).first()
    assert (found.s, found.t, found.q) == (True, "red wing", "find xii")


def test_the_day_before(spark):
    days = [(19160301, 19160229), (10101, -8769), (-9899, -18769), (20000101, 19991231), (20010301, 20010228)]
    got = spark.createDataFrame(days, "a long, b long").select("a", "b", temporal.previous_day(F.col("a")).alias("c"), temporal.following_day(F.col("b")).alias("d")).collect()
    assert all(r.c == r.b and r.d == r.a for r in got)


def test_running_sums_and_winners(spark):
    rows = spark.createDataFrame([(5, [1, 2, 3]), (7, []), (None, [1]), (1, None)], "s long, d array<long>")
    assert [r[0] for r in rows.select(segments.delta_decoded(F.col("s"), F.col("d"))).collect()] == [[5, 6, 8, 11], [7], None, None]
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 10, 0.8), (1, 11, 0.7), (2, 10, 0.5), (2, 12, 0.45), (3, 9, 0.1)], "a int, b int, s double")
    assert {tuple(r) for r in matching.clear_winners(pairs, "a", "b", "s", 0.1).collect()} == {(1, 10, 0.9), (3, 9, 0.1)}


def test_labels_have_no_cap_unless_asked(spark):
    rows = [("v", "g", f"k{i:04}", float(i), False, False, i * 10.0, 0.0, i * 10.0 + 2, 1.0) for i in range(1600)]
    table = spark.createDataFrame(rows, "view string, collision_group string, key string, priority double, selected boolean, pinned boolean, left double, top double, right double, bottom double")
    assert labels.layout(table).count() == 1600 and labels.layout(table, most=100).count() == 100


def test_shapes(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    kind = "ring array<struct<x:double,y:double>>"
    u = p((0, 0), (10, 0), (10, 10), (6, 10), (6, 2), (4, 2), (4, 10), (0, 10), (0, 0))
    inner = [p((1, 1), (9, 1), (9, 1.5), (1, 1.5), (1, 1)), p((1, 5), (9, 5), (9, 6), (1, 6), (1, 5)), p((0, 0), (10, 0), (10, 2), (0, 2), (0, 0)), p((20, 20), (21, 20), (21, 21), (20, 20)), []]
    rows = spark.createDataFrame([(u, i) for i in inner] + [(None, u)], f"outer array<struct<x:double,y:double>>, {kind}")
    assert [r[0] for r in rows.select(shapes.contains(F.col("outer"), F.col("ring"))).collect()] == [True, False, True, False, False, None]
    line = p(*((i, math.sin(i / 3)) for i in range(60)), (300, 0), (301, 0.001), (302, 0))
    got = spark.createDataFrame([(line,), (None,), ([],)], kind).select(shapes.simplified(F.col("ring"), 0.05).alias("s")).collect()
    kept = [(q.x, q.y) for q in got[0].s]
    assert got[1].s is None and got[2].s == [] and 10 < len(kept) < 40 and {(59.0, math.sin(59 / 3)), (300.0, 0.0), (302.0, 0.0)} <= set(kept) and (301.0, 0.001) not in kept
    issues = spark.createDataFrame([([],), (None,), (p((0, 0), (1, 1), (1, 1), (0, 0)),)], kind).select(shapes.ring_issues(F.col("ring"))).collect()
    assert issues[0][0] == ["few", "flat"] and issues[1][0] is None and issues[2][0] == ["repeated", "flat"]
