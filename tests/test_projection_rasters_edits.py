import pytest
from pyspark.sql import functions as F

from terrachron.functions import projection
from terrachron.operators import edits, labels, rasters


@pytest.mark.parametrize("kind, options", [("eqc", {"lat1": 30.0}), ("merc", {"lon0": 10.0}), ("lcc", {"lon0": 127.0, "lat0": 38.0, "lat1": 30.0, "lat2": 60.0}), ("laea", {"lon0": 100.0, "lat0": 30.0}), ("aeqd", {"lon0": 100.0, "lat0": 30.0}), ("stere", {"lat0": 90.0}), ("ortho", {"lon0": 120.0, "lat0": 20.0})])
def test_projections_come_back(spark, kind, options):
    points = spark.createDataFrame([(120.5, 37.25), (100.0, 30.0), (150.0, 5.0)], "lon double, lat double")
    there = points.withColumn("p", projection.forward(kind, F.col("lon"), F.col("lat"), **options))
    back = there.withColumn("q", projection.inverse(kind, F.col("p.x"), F.col("p.y"), **options)).collect()
    for r in back:
        assert (r.q.x, r.q.y) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))


def test_projection_values_and_domain(spark):
    one = spark.range(1)
    at = lambda kind, lon, lat, **o: one.select(projection.forward(kind, F.lit(lon), F.lit(lat), radius=1.0, **o).alias("p")).first().p
    assert at("merc", 90.0, 0.0).x == pytest.approx(1.5707963267948966) and at("merc", 0.0, 90.0) is None
    assert at("laea", 180.0, 0.0) is None and at("aeqd", 90.0, 0.0).x == pytest.approx(1.5707963267948966)
    assert at("ortho", 170.0, 0.0) is None and at("geographic", 181.0, 0.0) is None


def test_rasters(spark):
    levels = spark.createDataFrame([("a", 300, 150, 128)], "level string, width int, height int, tile_size int")
    tiles = rasters.tile_specs(levels)
    got = {(t.column, t.row): t for t in tiles.collect()}
    assert len(got) == 6 and (got[2, 1].pixel_width, got[2, 1].pixel_height) == (44, 22) and got[2, 1].east == 180.0 and got[0, 0].north == 90.0
    corner = tiles.where("column = 0 and row = 0")
    assert {(r.column, r.row) for r in rasters.neighbour_tiles(corner, 3, 2).collect()} == {(1, 0), (0, 1), (1, 1)}
    assert {r.column: r.fade for r in rasters.missing_neighbours(tiles.where("row = 0 and column < 2"), 3, 2).collect()} == {0: ["S", "W"], 1: ["E", "S"]}
    heights = spark.createDataFrame([(8.0,), (24.0,), (-300.0,), (-2000.0,), (1000.0,)], "h double").select(rasters.quantised_height(F.col("h")).alias("q")).collect()
    assert [r.q for r in heights] == [0, 32, -320, -2048, 992]
    flat = spark.createDataFrame([("a", x, y, 5.0) for x in range(3) for y in range(3)], "level string, x int, y int, value double")
    shades = {round(r.shade, 6) for r in rasters.hillshade(flat, 1.0, 1.0).collect()}
    assert shades == {round(0.42 + 0.58 * 0.5**0.5, 6)}
    assert rasters.averaged(flat, 3).first().value == 5.0


def test_edits(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "id string, parent_id string")
    make = lambda rows: spark.createDataFrame(rows, "id string, parent_id string")
    after, refused = edits.created(nodes, make([("c", "b"), ("a", "r"), ("d", "nowhere")]))
    assert {r.id for r in after.collect()} == {"r", "a", "b", "c"} and {tuple(r) for r in refused.collect()} == {("a", "exists"), ("d", "no such parent")}
    after, refused = edits.deleted(nodes, make([("b", None), ("r", None)]).select("id"))
    assert {r.id for r in after.collect()} == {"r", "a"} and [r.id for r in refused.collect()] == ["r"]
    after, refused = edits.reparented(nodes, make([("b", "r"), ("a", "b")]))
    assert dict(map(tuple, after.collect())) == {"r": None, "a": "b", "b": "r"} and refused.count() == 0
    after, refused = edits.reparented(nodes, make([("r", "b")]))
    assert dict(map(tuple, after.collect())) == {"r": None, "a": "r", "b": "a"} and [r.issue for r in refused.collect()] == ["cycle"]


def test_set_property(spark):
    rows = spark.createDataFrame([("A", "name", 19000101, 19191231, "old"), ("A", "name", 19300101, 19401231, "later")], "object_id string, property string, lo long, hi long, value string")
    life = spark.createDataFrame([("A", 19000101, 19401231), ("B", 19000101, 19501231)], "object_id string, lo long, hi long")
    change = lambda i: spark.createDataFrame([(i, "name", "new")], "object_id string, property string, value string")
    got = lambda i, month: {tuple(r)[2:] for r in edits.set_property(rows, life, change(i), month).where(F.col("object_id") == i).collect()}
    assert got("A", "1910-05") == {(19000101, 19100430, "old"), (19100501, 19191231, "new"), (19300101, 19401231, "later")}
    assert got("A", "1925-01") == {(19000101, 19191231, "old"), (19250101, 19291231, "new"), (19300101, 19401231, "later")}
    assert got("B", "1925-01") == {(19250101, 19501231, "new")} and got("X", "1925-01") == set()


def test_labels(spark):
    rows = [("v", "g", "a", 5, False, False, 0.0, 0.0, 10.0, 10.0), ("v", "g", "b", 4, False, False, 5.0, 5.0, 15.0, 15.0), ("v", "g", "c", 1, False, True, 5.0, 5.0, 15.0, 15.0), ("v", "h", "d", 1, False, False, 5.0, 5.0, 15.0, 15.0), ("v", "g", "e", 3, False, False, 40.0, 0.0, 50.0, 9.0)]
    table = spark.createDataFrame(rows, "view string, collision_group string, key string, priority int, selected boolean, pinned boolean, left double, top double, right double, bottom double")
    assert {r.key for r in labels.layout(table).collect()} == {"c", "d", "e"}
