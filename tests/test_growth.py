"""What shows on larger or odd tables only: equal sums, growth of windows and joins, sizes of what is sent."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terrachron.operators import bundles, few, hierarchy, lod, masks, matching, overlay, packs, shapes, terrain, territories
from terrachron.plans import territories as plans
from terrachron.registry import ORACLE_SQL, QUERIES
from terrachron.sources import shared


def against_sql(spark, folder, name, **tables):
    """The rows of a query and those of its SQL over some tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


def test_triangles_whose_boxes_touch_but_for_a_last_digit(spark, tmp_path):
    """26 + 0.452 and 27 - 0.548 are one place and two sums."""
    assert 27 - 0.548 < 26 + 0.452
    vectors = [[0.1465, 0.177, 0.226, 0.008, 0.031, 0.0205], [-0.0085, -0.0825, -0.0325, -0.2905, -0.274, 0.192]]
    rows = pa.table({"vec_id": pa.array([6506, 6507], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0, 0], pa.int64())})
    got, want = against_sql(spark, tmp_path, "q141_triangles", embeddings=rows)
    assert want == [(6506, 6507, 0.0, 0.19, 0.06)]
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def test_filled_columns_are_gone_through_once(spark):
    """A frame from a row to its partition's end is gone through again for each row: the work was the square of a raster's height."""
    rows = [(x, y, float(10 * y + x) if (x, y) in ((0, 4), (1, 0)) else None) for x in range(2) for y in range(6)]
    found = masks.filled(spark.createDataFrame(rows, "x long, y long, value double"))
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(found)
    got = {(r.x, r.y): (r.value, r.sx, r.sy) for r in found.collect()}
    assert got[0, 0] == got[1, 1] == got[0, 1] == (1.0, 1, 0)
    assert got[0, 5] == got[1, 3] == got[0, 3] == (40.0, 0, 4)
    assert got[0, 2] == (40.0, 0, 4)


def test_long_lines_of_parents_are_joined_by_sorted_parts(spark):
    """Tables of all nodes pack well, and were sent through the driver in each round."""
    n = 300
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), (F.col("id") * 7 % 101).cast("double").alias("value"))
    ends = hierarchy.roots(nodes).collect()
    assert all((r.root_id, r.steps, r.state) == (0, r.id, "Valid") for r in ends) and len(ends) == n
    joined = []
    written = hierarchy.settled
    try:
        hierarchy.settled = lambda df: joined.append(plan_of(df)) or written(df)
        found = {r.id: r.value for r in hierarchy.propagate_max(nodes, "value").collect()}
    finally:
        hierarchy.settled = written
    assert found == {i: max(j * 7 % 101 for j in range(i, n)) for i in range(n)}
    assert joined and not any("BroadcastHashJoin" in p for p in joined)


def test_ready_tiles_meet_missing_ones_by_cells(spark):
    """Each ready tile was held against each missing one."""
    rng = random.Random(5)
    made = []
    for i in range(300):
        w, s = rng.randrange(-40, 40) / 2, rng.randrange(-20, 20) / 2
        made.append((i, i % 3, w, s, w + rng.choice((0.5, 3.0, 11.0)), s + rng.choice((0.5, 2.0))))
    tiles = spark.createDataFrame(made, "id long, level int, w double, s double, e double, n double")
    target, ready = tiles.where("id % 20 = 1"), tiles.where("id % 2 = 0 or id % 60 = 1")
    found = terrain.ready_or_fallback(target, ready)
    assert not any("NestedLoop" in line and "LeftSemi" in line for line in plan_of(found).splitlines())
    missing = [t for t in made if t[0] % 20 == 1 and t[0] % 60 != 1]
    want = {(t[0], False) for t in made if t[0] % 60 == 1}
    want |= {(t[0], True) for t in made if t[0] % 2 == 0 and any(t[2] < m[4] and m[2] < t[4] and t[3] < m[5] and m[3] < t[5] for m in missing)}
    assert sorted((r.id, r.fallback) for r in found.collect()) == sorted(want)


def test_a_large_family_is_dealt_to_several_tasks(spark):
    """All pairs of a family were made by the task that had its parent, and all families by one task where a broadcast joined them."""
    rows = [(i, "p", "k") for i in range(60)] + [(i, None, "k") for i in range(60, 63)] + [(i, "p", "j") for i in range(63, 66)] + [(70, "p", None), (71, "p", None)]
    nodes = spark.createDataFrame(rows, "id long, parent_id string, kind string").coalesce(1)
    found = hierarchy.siblings(nodes, 5)
    families = [range(60), range(60, 63), range(63, 66)]
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for f in families for a in f for b in f if a != b)
    most = max(r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert most < 60 * 59 * 0.7


def test_winners_are_told_without_sorting_pairs(spark):
    """All pairs of an owner were sorted in a task, and those of all owners grouped before."""
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(12), rng.choice((None, 0.1, 0.3, 0.35, 0.9))) for _ in range(400)] + [(None, 1, 0.5), (50, 3, None)]
    pairs = spark.createDataFrame(rows, "a long, b long, s double")
    seen, written = [], matching.settled
    try:
        matching.settled = lambda df: seen.append(plan_of(df)) or written(df)
        found = matching.clear_winners(pairs, "a", "b", "s", 0.1)
    finally:
        matching.settled = written
    assert seen and not any("Window" in p for p in [*seen, plan_of(found)])
    want = set()
    for a in {r[0] for r in rows}:
        best = {}
        for x, b, s in rows:
            if x == a:
                best[b] = max(best.get(b, -1.0), -1.0 if s is None else s)
        order = sorted(((s, b) for b, s in best.items()), reverse=True)
        if len(order) == 1 or order[1][0] < 0 or order[0][0] - order[1][0] >= 0.1:
            want.add((a, order[0][1], None if order[0][0] < 0 else order[0][0]))
    assert set(map(tuple, found.collect())) == want


def test_larger_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    """What a task sorted of dated records and of tiles grew with the table, up to gigabytes."""
    monkeypatch.setattr(shared, "SORTED", 10)
    tasks = lambda df: df.rdd.getNumPartitions()
    rows = spark.range(95).select("id", (F.col("id") % 30).alias("object_id"), F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"))
    assert tasks(shared.dealt(rows, "object_id")) == 10 and tasks(shared.dealt(rows.limit(5), "object_id")) == 4
    found = bundles.record_issues(rows, rows, rows.withColumn("parent_id", F.col("object_id")))
    assert plan_of(found).count("RepartitionByExpression [object_id") >= 3
    assert {r.issue for r in found.collect()} == {"cycle"}


def test_edges_of_tiles_are_not_sent_whole_to_tasks(spark):
    rows = spark.range(20).select((F.col("id") % 5).alias("col"), F.floor(F.col("id") / 5).alias("row"), F.lit(3).alias("width"), F.lit(3).alias("height"), F.array(*[F.lit(7)] * 9).alias("data"))
    found = packs.edge_mismatches(rows, 5, 4)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert found.count() == 0


def _box(x, y, w, h, clockwise=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return [{"x": float(p), "y": float(q)} for p, q in (ring[::-1] if clockwise else ring)]


RINGS = "array<struct<x:double,y:double>>"


def _never(*_, **__):
    raise AssertionError("overlays of few edges need no such step")


def _problems(spark):
    rng = random.Random(5)
    rows = []
    for gid in range(30):
        for side in "ab":
            ring = [{"x": rng.randint(0, 40) / 7, "y": rng.randint(0, 40) / 7} for _ in range(rng.randint(3, 6))]
            rows.append((gid, side, False, ring + ring[:1]))
    return shared.settled(spark.createDataFrame(rows, f"gid long, side string, hole boolean, ring {RINGS}"))


def _areas(pieces):
    return {(r.gid, r.rule): round(r.area, 3) for r in overlay.areas(pieces, ["gid", "rule"]).collect()}


def test_overlays_of_few_edges_are_those_of_many(spark, monkeypatch):
    """Slanted edges cross off the grid, so some overlays are cut again."""
    rings, rules = _problems(spark), ["intersection", "union", "difference", "xor"]
    with monkeypatch.context() as m:
        m.setattr(overlay, "_cuts", _never)
        found = overlay.overlay(rings, rules)
        areas = _areas(found)
        kept = sorted((r.gid, round(r.area, 3), len(r.rings)) for r in overlay.polygons(found.where("rule = 'union'"), ["gid"]).collect())
    for limit in ("CORNERS", "PIECES"):
        with monkeypatch.context() as m:
            m.setattr(few, limit, 8)
            found = overlay.overlay(rings, rules)
            other = _areas(found)
            assert areas.keys() == other.keys() and all(abs(areas[k] - other[k]) < 0.002 for k in areas)
            again = sorted((r.gid, round(r.area, 3), len(r.rings)) for r in overlay.polygons(found.where("rule = 'union'"), ["gid"]).collect())
            assert [(g, n) for g, _, n in again] == [(g, n) for g, _, n in kept]


def test_rivals_are_told_before_shapes_are_overlaid(spark, monkeypatch):
    boxes = {1: _box(0, 0, 2, 1), 2: _box(1, 0, 2, 1), 3: _box(1.5, 0, 2, 1)}
    made = spark.createDataFrame([(k, False, r) for k, r in boxes.items()], f"id long, hole boolean, ring {RINGS}")
    rows = spark.createDataFrame([(1, 7, False), (2, 7, False), (3, 8, False)], "id long, parent long, snapshot boolean")
    asked = []
    inner = territories.pair_areas
    monkeypatch.setattr(territories, "pair_areas", lambda pairs, *rest: asked.extend(tuple(r) for r in pairs.collect()) or inner(pairs, *rest))
    after, log = territories.adjusted(rows, made, 1.0)
    assert asked == [(1, 2)]
    assert {r.id: round(r.area, 6) for r in territories.shape_areas(after).collect()} == {1: 1.0, 2: 1.0, 3: 2.0}


def test_polygons_of_few_edges_are_walked_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(overlay, "walks", _never)
    parts = spark.createDataFrame([(1, 0, False, _box(0, 0, 3, 1)), (2, 0, False, _box(9, 9, 1, 1, True))], f"id long, component int, hole boolean, ring {RINGS}")
    cutters = spark.createDataFrame([(5, False, _box(1, -1, 1, 3))], f"id long, hole boolean, ring {RINGS}")
    found = territories.component_difference(parts, cutters, 1.0).collect()
    assert sorted((r.id, r.area, len(r.rings[0])) for r in found) == [(1, 1.0, 5), (1, 1.0, 5), (2, 1.0, 5)]


def test_borders_of_one_edge_are_not_walked(spark, monkeypatch):
    monkeypatch.setattr(overlay, "walks", _never)
    made = spark.createDataFrame([(1, False, _box(0, 0, 1, 1)), (2, False, _box(1, 0.25, 1, 1))], f"id long, hole boolean, ring {RINGS}")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    found = territories.pair_borders(pairs, made).collect()
    assert [(r.a, r.b, r.line_no, r.length, [tuple(p) for p in r.points]) for r in found] == [(1, 2, 1, 0.75, [(1.0, 0.25), (1.0, 1.0)])]


def test_owners_of_a_simplified_map_are_walked_where_they_lie(spark, monkeypatch):
    """Only arcs, which may be as long as the map, go round by round."""
    rows = [(1, k, False, _box(k % 3, k // 3, 1, 1)) for k in range(9)]
    calls, inner = [], overlay.walks
    monkeypatch.setattr(overlay, "walks", lambda links: calls.append(1) or inner(links))
    found = lod.simplified_map(spark.createDataFrame(rows, f"gid int, owner int, hole boolean, ring {RINGS}"), 0.01).collect()
    assert sorted((r.owner, r.area) for r in found) == [(k, 1.0) for k in range(9)]
    assert len(calls) == 1


def test_large_row_groups_are_dealt_to_all_tasks(spark, tmp_path):
    rows = pa.table({"p_partkey": pa.array(range(400), pa.int64()), "p_size": pa.array([k % 50 + 1 for k in range(400)], pa.int64())})
    pq.write_table(rows, f"{tmp_path}/part.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("q112_rings", "q152_label_anchors"):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == tasks > 1


def test_rings_are_compared_with_those_of_their_length(spark):
    """Long ones alone, short ones together: the results stay in their rows."""
    wheel = [{"x": float(np.cos(2 * np.pi * i / 80)), "y": float(np.sin(2 * np.pi * i / 80))} for i in range(80)]
    bow = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    rings = [wheel + wheel[:1], _box(0, 0, 1, 1), bow, None, _box(0, 0, 1, 1)[:4], [], wheel]
    rows = spark.createDataFrame([(i, r, _box(-0.1, -0.1, 0.2, 0.2)) for i, r in enumerate(rings)], f"i int, a {RINGS}, b {RINGS}").coalesce(1)
    got = {r.i: (r.issues, r.holds) for r in rows.select("i", shapes.ring_issues(F.col("a")).alias("issues"), shapes.contains(F.col("a"), F.col("b")).alias("holds")).collect()}
    assert got == {0: ([], True), 1: ([], False), 2: (["flat", "crossing"], False), 3: (None, None), 4: (["open"], False), 5: (["few", "flat"], False), 6: (["open"], True)}


def test_overlays_of_few_edges_make_no_rows_of_pairs(spark):
    """Each two edges of an overlay were a row, grouped again by edge: most of the time of all overlays."""
    rings = _problems(spark)
    found = few.cut_and_kept(overlay.ring_edges(rings), lambda: F.array(F.struct(F.lit("any").alias("rule"), *few.ENDS)))
    assert "Generate inline(es" not in plan_of(found)
    labels = found.where("again = 0").count(), found.where("again = 1").count()
    assert all(labels)
    # Whole numbers need no rounding: the pieces are those of the general way.
    square = spark.createDataFrame([(g, s, False, _box(x, x, 4, 4)) for g in range(3) for s, x in (("a", 0), ("b", g))], f"gid int, side string, hole boolean, ring {RINGS}")
    kept = lambda: F.array(F.struct(F.concat_ws(",", "ra", "rb").alias("rule"), *few.ENDS))
    got = few.cut_and_kept(overlay.ring_edges(square, added_up=False), kept).select("gid", "rule", *few.ENDS)
    want = overlay.labelled(overlay.arranged(overlay.ring_edges(square))).select("gid", F.concat_ws(",", "ra", "rb").alias("rule"), *few.ENDS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shapes_of_one_row_group_are_made_by_all_tasks(spark):
    rows = spark.range(400).coalesce(1)
    shapes = plans._shapes(rows, "id", plans.rectangle(F.col("id"), F.lit(0), 1, 1))
    assert shapes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
