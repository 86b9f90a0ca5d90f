import sqlite3

import pytest
from pyspark.sql import functions as F

from terrachron.operators import places, rivers
from terrachron.sources import files, geonames, geopackage
from terrachron.streaming import latest


def test_candidates_and_scores(spark):
    rows = [(1, "P", "PPLC", 10, 0.0, 0.0), (2, "P", "PPL", 60_000, 0.5, 0.0), (3, "P", "PPL", 10, 1.0, 0.0), (4, "A", "PPLC", 10, 1.0, 0.0), (5, "P", "PPLA", 2_000_000, 50.0, 0.0)]
    table = spark.createDataFrame(rows, "id int, feature_class string, feature_code string, population long, lon double, lat double")
    got = {r.id: r for r in places.candidates(table).collect()}
    assert {i: (r.inclusion_reason, r.population_bucket, r.display_mode) for i, r in got.items()} == {
        1: ("capital", "under-50k-admin", "search-only"), 2: ("population-50k", "50k-99k", "search-only"), 5: ("admin-seat-1", "1m-plus", "auto-review"),
    }
    scores = {r.id: r for r in places.display_scores(places.candidates(table)).collect()}
    assert scores[5].tier == 1 and scores[5].nearest_peer_km is None and scores[1].nearest_peer_km == pytest.approx(55.6, abs=0.1)


def test_names(spark):
    line = F.from_json(F.lit('[{"from_key":19000101,"ko":"가","en":"Old"},{"from_key":19500101,"en":"New"}]'), "array<struct<from_key:bigint,ko:string,en:string,native:string>>")
    at = lambda lang, day: spark.range(1).select(places.name_at(line, F.lit("base"), lang, day).alias("v")).first().v
    assert tuple(at("en", 18000101)) == ("base", False) and tuple(at("en", 19200101)) == ("Old", True) and tuple(at("en", 19600101)) == ("New", True)
    assert tuple(at("ko", 19600101)) == ("가", True) and tuple(at("native", 19600101)) == ("base", False)
    town = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    proof = spark.createDataFrame([("a", False, "1900-01-01", "1950-01-01"), ("b", True, "2000-01-01", None)], "source_id string, provisional boolean, valid_from string, until string")
    assert {r.source_id for r in places.urban_at(town, proof, F.lit("1950-01-01")).collect()} == {"b", "c"}


def test_rivers(spark):
    rows = [(1, None, 1, 1.0, 100.0), (2, 1, 1, 3.0, 60.0), (3, 1, 1, 9.0, 40.0), (4, 2, 1, 2.0, 30.0), (5, 2, 1, 7.0, 30.0), (6, None, 2, 1.0, 5.0)]
    reaches = spark.createDataFrame(rows, "id long, next_id long, ord int, flow double, upstream_area double").withColumn("width", F.col("flow"))
    chain = {r.id: (r.chain_id, r.position) for r in rivers.chains(reaches).collect()}
    assert chain == {1: (1, 0), 2: (1, 1), 5: (1, 2), 3: (3, 0), 4: (4, 0), 6: (6, 0)}
    assert {r.id: r.width for r in rivers.widths_downstream(reaches).collect()} == {1: 9.0, 2: 7.0, 3: 9.0, 4: 2.0, 5: 7.0, 6: 1.0}
    assert {r.id for r in rivers.excluded_basins(reaches, spark.createDataFrame([(1,)], "id long")).collect()} == {6}
    parts = rivers.fragments(rivers.chains(reaches).withColumn("stage", F.when(F.col("id") == 5, 2)), ["position"], "stage")
    assert {r.id: r.fragment for r in parts.where("chain_id = 1").collect()} == {1: 1, 2: 1, 5: 2}


def test_geonames(spark, tmp_path):
    good = ["7", "Town", "Town", "", "10.5", "20.25", "P", "PPL", "KR", "", "", "", "", "", "", "", "", "Asia", "2020-01-01"]
    lines = ["\t".join(good), "\t".join(good[:-1]), "\t".join(["x", *good[1:]]), "\t".join([*good[:4], "95", *good[5:]])]
    (tmp_path / "rows.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = geonames.read(spark, str(tmp_path / "rows.txt"))
    assert sorted(str(r.issue) for r in rows.collect()) == ["None", "expected 19 columns", "invalid latitude", "invalid numeric field"]
    one = geonames.sound(rows).first()
    assert (one.geoname_id, one.population, one.population_missing, one.longitude) == (7, 0, True, 20.25)


def test_geopackage(spark, tmp_path):
    shapes = [("Point", [[[(1.0, 2.0)]]]), ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]]), ("MultiPolygon", [[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]]])]
    for kind, coords in shapes:
        assert geopackage.decode(geopackage.encode(kind, coords)) == (kind, coords)
    with pytest.raises(ValueError):
        geopackage.decode(geopackage.encode(*shapes[0]) + b"x")
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("create table projectState (id text, body text)")
    con.execute("insert into projectState values ('p', '{\"v\": 14}')")
    con.commit()
    con.close()
    spark.dataSource.register(geopackage.GeoPackage)
    row = spark.read.format("geopackage").option("table", "projectState").load(str(tmp_path / "*.gpkg")).first()
    assert '"id": "p"' in row.json
    blobs = spark.createDataFrame([(bytearray(geopackage.encode(*shapes[0])),)], "b binary").select(geopackage.geometry_of("b").alias("g")).first().g
    assert blobs.type == "Point" and blobs.coords[0][0][0].x == 1.0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, "x" * 90) for i in range(10)], "key string, id int, body string")
    shaped = rows.withColumn("geometry", F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")))
    made = files.features(shaped, "geometry", ["id", "body"])
    files.write_parts(made, "key", "feature", str(tmp_path / "out"), 400)
    assert spark.read.text(str(tmp_path / "out")).count() == 10
    assert len(list((tmp_path / "out" / "key=k").iterdir())) == 5
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    found = files.manifest(spark, str(tmp_path / "m" / "*"))
    declared = found.union(found.limit(1).withColumn("name", F.lit("gone")))
    assert [tuple(r) for r in files.manifest_issues(declared, found).collect()] == [("gone", "missing")]
    chunks = spark.createDataFrame([("f", 1, bytearray(b"b")), ("f", 0, bytearray(b"a"))], "name string, position int, content binary")
    assert bytes(files.reassembled(chunks).first().content) == b"ab"


def test_latest_revisions(spark, tmp_path):
    source = tmp_path / "in"
    for i, rows in enumerate([[("a", 1, "p"), ("a", 3, "q"), ("b", 1, "r")], [("a", 2, "late"), ("b", 2, "s")]]):
        spark.createDataFrame(rows, "key string, revision long, payload string").coalesce(1).write.mode("append").parquet(str(source))
        query = (
            latest.latest_revisions(spark.readStream.schema("key string, revision long, payload string").parquet(str(source)))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = {(r.key, r.revision, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 3, "q"), ("b", 1, "r"), ("b", 2, "s")}


def test_staged_batches(spark, tmp_path):
    schema = "id long, v string"
    spark.createDataFrame([(i, str(i)) for i in range(20)], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows, found = latest.staged(stream(), str(tmp_path / "a"), "")
    assert rows.count() == 20
    assert latest.staged(stream(), str(tmp_path / "b"), found)[1] == found
    with pytest.raises(ValueError):
        latest.staged(stream(), str(tmp_path / "c"), "0" * 64)
