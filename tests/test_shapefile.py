"""Shapefiles: what is written is read back, filters reach the boxes, skipped shapes aren't decoded."""

import glob
import struct

import pytest
from pyspark.sql import functions as F

from terrachron.sources.shapefile import Shapefile

SCHEMA = "parts array<array<struct<x:double,y:double>>>, id long, name string, area double, big boolean"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    spark.dataSource.register(Shapefile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    k = F.col("p_partkey")
    at = lambda dx, dy: F.struct((k % 40 + dx).cast("double").alias("x"), (F.floor(k / 40) + dy).cast("double").alias("y"))
    ring, hole = F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0), at(0, 0)), F.array(at(0.2, 0.2), at(0.4, 0.2), at(0.4, 0.4), at(0.2, 0.2))
    parts = F.when(k % 50 == 7, F.lit(None)).when(k % 3 == 0, F.array(ring, hole)).otherwise(F.array(ring))
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(parts.alias("parts"), k.alias("id"), F.when(k % 9 != 0, F.concat("p_name", F.lit(" é"))).alias("name"), F.col("p_retailprice").alias("area"), F.when(k % 4 != 0, k % 2 == 0).alias("big"))
    folder = str(tmp_path_factory.mktemp("shapes"))
    rows.repartition(2).write.format("shapefile").mode("append").save(folder)
    assert not glob.glob(f"{folder}/*.part") and len(glob.glob(f"{folder}/*.shp")) == 2
    return rows, folder


def load(spark, folder, **options):
    return spark.read.format("shapefile").options(**options).load(f"{folder}/*.shp")


def test_round_trip(spark, written):
    rows, folder = written
    got = load(spark, folder, range="30")
    assert dict(got.dtypes)["id"] == "bigint" and got.rdd.getNumPartitions() >= 8
    assert sorted(map(repr, got.select("parts", "id", "name", "area", "big").collect())) == sorted(map(repr, rows.collect()))


def test_filters_equal_filtering_afterwards(spark, written):
    _, folder = written
    every = load(spark, folder).collect()
    for text, test in (("w <= 12 and e >= 10 and n > 2", lambda r: r.w is not None and r.w <= 12 and r.e >= 10 and r.n > 2), ("record >= 40 and record < 45", lambda r: 40 <= r.record < 45), ("record = 3 or w < 1", lambda r: r.record == 3 or (r.w is not None and r.w < 1)), ("w = 5 and id > 50", lambda r: r.w == 5 and r.id > 50)):
        assert sorted(map(repr, load(spark, folder, range="16", pushdown="true").where(text).collect())) == sorted(map(repr, filter(test, every))), text


def test_skipped_shapes_are_not_decoded(spark, written, tmp_path):
    _, folder = written
    first = sorted(glob.glob(f"{folder}/*.shp"))[0]
    for end in ("shp", "shx", "dbf"):
        (tmp_path / f"x.{end}").write_bytes(open(f"{first[:-4]}.{end}", "rb").read())
    data = bytearray((tmp_path / "x.shp").read_bytes())
    at, edges = 100, []
    while at < len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        if struct.unpack("<i", data[at + 8 : at + 12])[0]:
            edges.append((struct.unpack("<d", data[at + 28 : at + 36])[0], at))
        at += 8 + size
    east, worst = max(edges)
    struct.pack_into("<i", data, worst + 8 + 36, 1_000_000)  # so many parts that decoding it fails
    (tmp_path / "x.shp").write_bytes(data)
    source = spark.read.format("shapefile")
    fewer = source.option("pushdown", "true").load(str(tmp_path / "x.shp")).where(f"e < {east}")
    assert fewer.count() == sum(e < east for e, _ in edges)
    boxed = spark.read.format("shapefile").option("box", f"-1,-1,{east - 1.5},1000").load(str(tmp_path / "x.shp"))
    assert len(boxed.collect()) == sum(e - 1 <= east - 1.5 for e, _ in edges)
    with pytest.raises(Exception, match="size isn't that of its parts"):
        spark.read.format("shapefile").load(str(tmp_path / "x.shp")).collect()
    narrow = spark.read.format("shapefile").schema("record long, id long").load(str(tmp_path / "x.shp"))
    assert narrow.count() == len(load(spark, folder).where(F.col("file") == first).collect())


def test_points_and_lines(spark, tmp_path):
    rows = [([[(1.0, 2.0)]], 1, "a", 0.5, True), (None, 2, None, None, None), ([[(3.0, 4.0)]], 3, "b", -1e-9, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.format("shapefile").mode("append").option("kind", "Point").save(str(tmp_path / "p"))
    got = {r.id: r for r in load(spark, str(tmp_path / "p")).collect()}
    assert [tuple(got[1].parts[0][0]), got[2].parts, tuple(got[3].parts[0][0])] == [(1, 2), None, (3, 4)]
    assert (got[2].w, got[2].name, got[2].area, got[2].big, got[3].area, got[3].big) == (None, None, None, None, -1e-9, False)
    lines = spark.createDataFrame([([[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 7.0), (8.0, 9.0)]], 1, "l", 1.0, None)], SCHEMA)
    for kind in ("PolyLine", "MultiPoint"):
        lines.coalesce(1).write.format("shapefile").mode("append").option("kind", kind).save(str(tmp_path / kind))
        r = load(spark, str(tmp_path / kind)).first()
        assert [len(p) for p in r.parts] == ([2, 3] if kind == "PolyLine" else [5]) and (r.w, r.s, r.e, r.n) == (0, 0, 8, 9)
