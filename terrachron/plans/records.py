"""Queries over references, edits, files, tiles, entities and shapes, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.functions import projection
from terrachron.functions.geometry import signed_area
from terrachron.operators import calibration, changes, edits, entities, matching, quality, ranges, ranking, rasters, shapes, terrain
from terrachron.plans.proofs import _DAY, _LAT, _LON, _RING, _TREE, _tree, day, points
from terrachron.plans.queries import query
from terrachron.sources import files, geonames, geopackage
from terrachron.sources.shared import dealt, shared_dir
from terrachron.sources.tables import table
from terrachron.streaming import latest


@query("SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem")
def q73_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners of each reference."""
    return matching.users(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 25 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount >= 0.03")
def q74_missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of active rows that aren't loaded."""
    rows = table(spark, sf_dir, "lineitem")
    return matching.missing_references(rows.where("l_quantity < 25"), rows.where("l_discount >= 0.03"), ["l_partkey", "l_suppkey"])


@query("SELECT 'same-place' AS rule, concat_ws('|', p_size, p_brand) AS key, CAST(count(*) AS VARCHAR) AS detail FROM part GROUP BY p_size, p_brand HAVING count(*) > 1 UNION ALL SELECT 'low', CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR) FROM part WHERE NOT (p_size >= 5) UNION ALL SELECT 'late', concat_ws('|', o_custkey, o_orderkey), CAST(lo AS VARCHAR) FROM (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT o_custkey, o_orderkey, {0} AS lo, {1} AS hi FROM orders)) WHERE reach > lo".format(_DAY.format("o_orderdate"), _DAY.format("o_orderdate + INTERVAL 30 DAY")))
def q75_document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal places, failing rows and overlaps in one report."""
    parts = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders").withColumn("_end", F.col("o_orderdate") + F.expr("interval 30 days")).select("o_custkey", "o_orderkey", day("o_orderdate").alias("lo"), day("_end").alias("hi"))
    return quality.report(quality.duplicates(parts, ["p_size", "p_brand"], "same-place"), quality.failing(parts, "p_partkey", F.col("p_size") >= 5, F.col("p_size"), "low"), quality.overlaps(orders, ["o_custkey"], "lo", "hi", ["o_orderkey"], "late"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(sum(c_acctbal * (c_nationkey % 2)) / sum(c_acctbal), 6) AS residual, max(abs(c_acctbal / 5000 - 1)) <= 1.1 AS accepted, round(count(*) / 25.0 * 100, 6) AS whole FROM customer GROUP BY c_mktsegment")
def q76_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample summaries, residual shares, acceptance, extrapolation."""
    v, rows = F.col("c_acctbal"), table(spark, sf_dir, "customer")
    found = rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(entities.residual_share(v, F.col("c_nationkey") % 2), 6).alias("residual"),
        calibration.accepted(v / 5000, 1.1).alias("accepted"), F.round(entities.extrapolated(F.count("*"), F.lit(25), 100), 6).alias("whole"),
    )
    return found.join(ranges.quantiles(rows, ["c_mktsegment"], "c_acctbal", {"median": 0.5}).select("c_mktsegment", F.round("median", 6).alias("median")), "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + 99) // 100 AS INTEGER) AS batch FROM orders")
def q77_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in pages of a hundred for each status."""
    return matching.batches(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], 100).select("o_orderkey", "o_totalprice", "batch")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q78_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest orders."""
    return ranking.top(table(spark, sf_dir, "orders"), 25, [F.desc("o_totalprice"), F.asc("o_orderkey")])[0].select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT l_orderkey AS key, l_linenumber - 1 AS i, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top, l_suppkey AS s FROM lineitem),
w AS (SELECT key FROM r GROUP BY key HAVING max(n) = max(top) AND count(DISTINCT i) = count(*) AND min(i) = 0)
SELECT key, array_to_string(list(p ORDER BY i), ',') AS lines FROM r JOIN w USING (key) GROUP BY key""")
def q79_fragments_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments joined in order where all are there once (U8)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).cast("long").alias("i"), F.array("l_partkey").alias("lines"))
    totals = rows.groupBy("key").agg((F.max("i") + 1).alias("total"))
    return matching.whole_fragments(rows.join(totals, "key"), "key", "i", "total", "lines").select("key", F.array_join("lines", ",").alias("lines"))


@query(f"""
WITH p AS (SELECT vec_id AS id, {_LON} AS x, {_LAT} AS y FROM embeddings)
SELECT id, round(6371008.8 * radians(x), 2) AS eqc_x, round(6371008.8 * radians(y), 2) AS eqc_y, round(6371008.8 * ln(tan(pi() / 4 + radians(y) / 2)), 2) AS merc_y,
round(6371008.8 * sqrt(2 / (1 + cos(radians(y)) * cos(radians(x)))) * cos(radians(y)) * sin(radians(x)), 2) AS laea_x, round(x, 6) AS back_x, round(y, 6) AS back_y,
abs(x) > 90 AS eqc_outside, abs(y) > 90 AS geo_outside FROM p WHERE abs(x) < 175 AND abs(y) < 85""")
def q80_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections forwards and back, and points outside the map."""
    x, y = F.col("lon"), F.col("lat")
    eqc, merc, laea = (projection.forward(k, x, y) for k in ("eqc", "merc", "laea"))
    rows = points(spark, sf_dir).where((F.abs(x) < 175) & (F.abs(y) < 85)).select("id", "lon", "lat", eqc.alias("e"), merc.alias("m"), laea.alias("l"))
    back = projection.inverse("laea", F.col("l.x"), F.col("l.y"))
    outside = projection.inverse("eqc", F.col("e.x") * 2, F.col("e.y"))
    return rows.select(
        "id", F.round("e.x", 2).alias("eqc_x"), F.round("e.y", 2).alias("eqc_y"), F.round("m.y", 2).alias("merc_y"), F.round("l.x", 2).alias("laea_x"), F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 6).alias("back_y"),
        outside.isNull().alias("eqc_outside"), projection.inverse("geographic", x, y).isNull().alias("geo_outside"),
    )


_GRID = "SELECT CAST(p_partkey % 20 AS BIGINT) AS x, CAST(p_partkey // 20 AS BIGINT) AS y, p_retailprice AS value FROM part"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of the prices of all parts, 20 columns wide."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 20).alias("x"), F.floor(k / 20).cast("long").alias("y"), F.col("p_retailprice").alias("value"))


@query(f"""
WITH g AS ({_GRID}), h AS (SELECT max(y) + 1 AS h FROM g), t AS (SELECT tx, ty, px, py FROM range(0, 10) a(tx), (SELECT unnest(range(0, (SELECT h // 2 FROM h))) AS ty) b, range(-1, 3) c(px), range(-1, 3) d(py))
SELECT tx, ty, px, py, value FROM t JOIN g ON x = (tx * 2 + px + 20) % 20 AND y = least((SELECT h FROM h) - 1, greatest(0, ty * 2 + py))""")
def q81_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with a border: columns wrap, rows end (K8)."""
    grid = _grid(spark, sf_dir)
    height = grid.agg(F.max("y")).first()[0] + 1
    return terrain.with_gutters(grid, 20, height, 2).select("tx", "ty", "px", "py", "value")


@query(f"""
WITH g AS ({_GRID}), n AS (SELECT a.*, coalesce(w.value, a.value) AS vw, coalesce(e.value, a.value) AS ve, coalesce(n.value, a.value) AS vn, coalesce(s.value, a.value) AS vs FROM g a LEFT JOIN g w ON w.x = a.x - 1 AND w.y = a.y LEFT JOIN g e ON e.x = a.x + 1 AND e.y = a.y LEFT JOIN g n ON n.x = a.x AND n.y = a.y - 1 LEFT JOIN g s ON s.x = a.x AND s.y = a.y + 1),
d AS (SELECT *, (ve - vw) / 60 AS dx, (vn - vs) / 60 AS dy FROM n)
SELECT x, y, round(0.42 + 0.58 * greatest(0.0, (-dx * sin(radians(315)) * cos(radians(45)) - dy * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(1 + dx * dx + dy * dy)), 8) AS shade FROM d""")
def q82_hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shades of a raster."""
    found = rasters.hillshade(_grid(spark, sf_dir).withColumn("level", F.lit(0)), 30.0, 30.0)
    return found.select("x", "y", F.round("shade", 8).alias("shade"))


@query(f"WITH g AS ({_GRID}) SELECT x // 2 AS x, y // 2 AS y, round(avg(value), 6) AS value FROM g GROUP BY 1, 2")
def q83_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next coarser level."""
    return rasters.averaged(_grid(spark, sf_dir).withColumn("level", F.lit(0)), 2).select("x", "y", F.round("value", 6).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN h < 0 THEN -round_even(-h / st, 0) * st ELSE round_even(h / st, 0) * st END AS BIGINT) AS height, round(2.4 + 2.05 * log2(greatest(1.0, l_quantity)), 8) AS threshold, CAST(ceil(l_quantity * 40 / 256) AS BIGINT) || 'x' || CAST(ceil(l_extendedprice / 256) AS BIGINT) AS size
FROM (SELECT *, CASE WHEN h < 0 THEN CASE WHEN -h < 256 THEN 16 WHEN -h < 1024 THEN 64 ELSE 128 END ELSE CASE WHEN h < 256 THEN 16 ELSE 32 END END AS st FROM (SELECT *, l_quantity * 60 - 1000 AS h FROM lineitem))""")
def q84_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights in steps, zoom thresholds, size classes."""
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rasters.quantised_height(q * 60 - 1000).alias("height"), F.round(terrain.zoom_threshold(q), 8).alias("threshold"), terrain.size_class(q * 40, F.col("l_extendedprice")).alias("size"))


_LEVELS = "SELECT n_nationkey AS level, 100 * (n_nationkey + 1) AS width, 50 * (n_nationkey + 1) AS height, 64 AS tile_size FROM nation"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("level"), (100 * n).alias("width"), (50 * n).alias("height"), F.lit(64).alias("tile_size"))


@query(f"""
WITH l AS ({_LEVELS}), t AS (SELECT level, width, height, c, r, c * 64 AS x0, r * 64 AS y0, least(width, c * 64 + 64) AS x1, least(height, r * 64 + 64) AS y1 FROM l, range(0, 50) a(c), range(0, 30) b(r) WHERE c * 64 < width AND r * 64 < height)
SELECT level, CAST(c AS INTEGER) AS column, CAST(r AS INTEGER) AS row, CAST(x1 - x0 AS INTEGER) AS pixel_width, CAST(y1 - y0 AS INTEGER) AS pixel_height, round(-180 + x0 / width * 360, 9) AS west, round(90 - y0 / height * 180, 9) AS north, round(-180 + x1 / width * 360, 9) AS east, round(90 - y1 / height * 180, 9) AS south FROM t""")
def q85_tile_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of raster levels."""
    found = rasters.tile_specs(_levels(spark, sf_dir))
    return found.select("level", "column", "row", "pixel_width", "pixel_height", *(F.round(c, 9).alias(c) for c in ("west", "north", "east", "south")))


@query("""
WITH t AS (SELECT DISTINCT 0 AS level, CAST(p_partkey % 37 AS INTEGER) AS c, CAST(p_size AS INTEGER) AS r FROM part)
SELECT DISTINCT 0 AS level, CAST(c + dx AS INTEGER) AS column, CAST(r + dy AS INTEGER) AS row FROM t, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE c + dx BETWEEN 0 AND 39 AND r + dy BETWEEN 0 AND 49 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.c = t.c + dx AND u.r = t.r + dy)""")
def q86_neighbour_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles around given ones."""
    tiles = table(spark, sf_dir, "part").select(F.lit(0).alias("level"), (F.col("p_partkey") % 37).cast("int").alias("column"), F.col("p_size").cast("int").alias("row")).distinct()
    return rasters.neighbour_tiles(tiles, 40, 50)


@query(f"""
WITH l AS ({_LEVELS}), t AS (SELECT l_linenumber AS level, l_extendedprice AS b FROM lineitem)
SELECT (SELECT min(level) FROM l WHERE width >= 1.12 * 700) AS level, false AS limited, (SELECT max(level) FROM (SELECT level, sum(b) AS s FROM t WHERE level <= 5 GROUP BY level) WHERE s + 1000 <= 1e12) AS within""")
def q87_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that is wide enough, and the finest that fits a budget."""
    best = terrain.level_for(_levels(spark, sf_dir), F.lit(700))
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_extendedprice").alias("bytes"))
    within = terrain.level_within(tiles, 5, 1000, 10**12).select(F.col("level").alias("within"), F.lit(1).alias("_k"))
    return best.withColumn("_k", F.lit(1)).join(within, "_k").select("level", "limited", "within")


@query("""
WITH b AS (SELECT p_partkey AS id, p_size % 3 AS level, p_size * 3.0 AS w, (p_partkey % 20) * 2.0 AS s, p_partkey % 2 = 0 AS ready, p_partkey % 50 = 1 AS target FROM part),
m AS (SELECT * FROM b WHERE target AND NOT ready)
SELECT id, level, false AS fallback FROM b WHERE target AND ready
UNION ALL SELECT id, level, true FROM b WHERE ready AND NOT target AND EXISTS (SELECT 1 FROM m WHERE b.w < m.w + 5 AND m.w < b.w + 5 AND b.s < m.s + 3 AND m.s < b.s + 3)""")
def q88_ready_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready tiles, and others in place of those that aren't."""
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") % 3).alias("level"), (F.col("p_size") * 3.0).alias("w"), ((k % 20) * 2.0).alias("s")).withColumns({"e": F.col("w") + 5, "n": F.col("s") + 3})
    return terrain.ready_or_fallback(boxes.where("id % 50 = 1"), boxes.where("id % 2 = 0")).select("id", "level", "fallback")


@query(f"""
WITH n AS ({_TREE})
SELECT * FROM n WHERE NOT (kind = 'supplier' AND id IN (SELECT 's' || (s_suppkey * 3) FROM supplier)) UNION ALL SELECT 'new' || s_suppkey, 'n' || s_nationkey, 'supplier' FROM supplier WHERE s_suppkey % 2 = 0""")
def q89_created_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows created and deleted, refusals left out (D3)."""
    nodes, s = _tree(spark, sf_dir), table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    new = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("new"), k).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_id"), F.lit("supplier").alias("kind"))
    bad = s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("bad"), k).alias("id"), F.lit("n99").alias("parent_id"), F.lit("supplier").alias("kind"))
    rows, _ = edits.created(nodes, new.union(bad).union(nodes.where("id = 'r0'")))
    gone = s.select(F.concat(F.lit("s"), (F.col("s_suppkey") * 3).cast("string")).alias("id")).union(nodes.where("kind = 'region'").select("id"))
    kept, _ = edits.deleted(rows, gone)
    return kept.select("id", F.col("parent_id").alias("p"), "kind")


@query(f"""
WITH n AS ({_TREE})
SELECT id, CASE WHEN kind = 'supplier' AND CAST(substr(id, 2) AS INTEGER) % 2 = 0 THEN 'n1' ELSE p END AS parent_id FROM n""")
def q90_reparented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves to new parents; those into a cycle or to nowhere are refused."""
    nodes = _tree(spark, sf_dir)
    moves = nodes.where("kind = 'supplier' and cast(substr(id, 2) as int) % 2 = 0").select("id", F.lit("n1").alias("parent_id"))
    wrong = spark.createDataFrame([("r1", "n1"), ("s1", "n77")], "id string, parent_id string")
    first, _ = edits.reparented(nodes, wrong)
    return edits.reparented(first, moves)[0].select("id", "parent_id")


@query("""
WITH b AS (SELECT c_custkey AS k, c_custkey AS o, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT c_custkey AS k, c_custkey AS o, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0),
e AS (SELECT c_custkey AS k, c_custkey AS o FROM customer WHERE c_custkey % 13 = 0),
u AS (SELECT k, 0 AS part, o FROM e UNION ALL SELECT b.k, 1, b.o FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL OR a.v IS DISTINCT FROM b.v UNION ALL SELECT a.k, 2, a.o FROM a LEFT JOIN b USING (k) WHERE b.k IS NULL)
SELECT k, CAST(min(part) AS INTEGER) AS part, min(o) AS at FROM u GROUP BY k""")
def q91_dirty_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be saved again, in its order."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), k.alias("ord"), F.col("c_acctbal").alias("v"))
    after = rows.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("v")))
    found = edits.dirty_ids(rows.where("k % 13 = 0"), rows.where("k % 7 <> 0"), after, "k", "v")
    return found.select("k", "rank.part", "rank.at")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0")
def q92_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base with a delta put back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    changed = rows.where("c_custkey % 5 = 0").withColumn("name", F.lit("new"))
    return changes.restore(rows, changed, rows.where("c_custkey % 7 = 0 and c_custkey % 5 <> 0"), "c_custkey")


@query("""
WITH f AS (SELECT c_mktsegment, c_custkey, '{"type":"Feature","properties":{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"},"geometry":{"type":"Point","coordinates":[' || c_nationkey || ',' || c_custkey % 90 || ']}}' AS feature FROM customer)
SELECT c_mktsegment, feature, CAST(floor(coalesce(sum(length(feature) + 1) OVER (PARTITION BY c_mktsegment ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096) AS INTEGER) AS part FROM f""")
def q93_feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as JSON in parts of bounded size."""
    rows = table(spark, sf_dir, "customer").withColumn("g", F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 90).alias("coordinates")))
    return files.parts(files.features(rows, "g", ["c_custkey", "c_name"]), "c_mktsegment", "feature", 4096).select("c_mktsegment", "feature", "part")


@query("""
SELECT c_custkey AS geoname_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 180 - 90) * 1.0 END AS latitude, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS population, c_custkey % 5 = 0 AS population_missing,
CASE WHEN c_custkey <= 0 THEN 'invalid ID or name' WHEN c_custkey % 6 = 0 THEN 'invalid latitude' WHEN c_custkey % 5 <> 0 AND floor(c_acctbal) < 0 THEN 'negative population' END AS issue FROM customer""")
def q94_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer rows written as text and read back with their issues."""
    k = F.col("c_custkey")
    text = {"geoname_id": k.cast("string"), "name": F.col("c_name"), "latitude": F.when(k % 6 == 0, "north").otherwise((k % 180 - 90).cast("string")), "longitude": F.col("c_nationkey").cast("string"), "population": F.when(k % 5 == 0, "").otherwise(F.floor("c_acctbal").cast("string"))}
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("\t", *(text.get(c, F.lit("x")) for c in geonames.COLUMNS)).alias("value"))
    path = f"{shared_dir(spark)}/tc-{uuid.uuid4().hex}"
    lines.write.text(path)
    return geonames.read(spark, path).select("geoname_id", "latitude", "population", "population_missing", "issue")


@query("""
WITH d AS (SELECT p_name || p_partkey AS name, p_size AS bytes, p_brand AS h FROM part WHERE p_partkey % 7 <> 0), f AS (SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS bytes, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END AS h FROM part WHERE p_partkey % 11 <> 0)
SELECT name, CASE WHEN f.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'unexpected' WHEN d.bytes <> f.bytes THEN 'size' ELSE 'content' END AS issue FROM d FULL JOIN f USING (name) WHERE f.h IS NULL OR d.h IS NULL OR d.bytes <> f.bytes OR d.h <> f.h""")
def q95_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a declared manifest and the files differ."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat("p_name", k.cast("string")).alias("name"), F.col("p_size").alias("bytes"), F.col("p_brand").alias("sha256"))
    found = rows.withColumns({"bytes": F.when(k % 5 == 0, 0).otherwise(F.col("bytes")), "sha256": F.when(k % 3 == 0, "x").otherwise(F.col("sha256"))})
    return files.manifest_issues(rows.where(k % 7 != 0), found.where(k % 11 != 0))


@query("SELECT CAST(conv_id AS VARCHAR) AS name, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def q96_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined in order, with their digest."""
    chunks = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("name"), F.col("turn").alias("position"), F.col("text").cast("binary").alias("content"))
    return files.reassembled(chunks).select("name", "sha256", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT user_id AS key, max(event_id) AS revision, arg_max(event_type, event_id) AS payload FROM events GROUP BY user_id")
def q97_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's latest revision."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.col("event_type").alias("payload"))
    return latest.latest_of_table(rows).select("key", "revision", "payload")


@query(f"SELECT vec_id AS id, 'Point' AS type, {_LON} AS x, {_LAT} AS y FROM embeddings")
def q98_geometry_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to geometry blobs and back."""
    blob = F.udf(lambda x, y: geopackage.encode("Point", [[[(x, y)]]]), "binary", useArrow=True)
    rows = points(spark, sf_dir).select("id", geopackage.geometry_of(blob("lon", "lat")).alias("g"))
    p = F.col("g.coords")[0][0][0]
    return rows.select("id", "g.type", p["x"].alias("x"), p["y"].alias("y"))


@query("""
SELECT p_partkey, 'geo:' || p_type || ':' || replace(replace(p_brand, '#', '%23'), ' ', '+') AS key, CASE WHEN p_partkey % 3 = 0 THEN 'extra' ELSE '' END AS unknown,
array_to_string([CAST(i * p_size // least(p_size, 4) AS VARCHAR) FOR i IN range(0, least(p_size, 4))], ',') AS sampled,
p_size * 1e-10 > greatest(1e-10, p_retailprice * 1e3 * 1e-9) AS significant, CASE WHEN p_size * 1e-9 <= 1e-8 THEN 'trace' ELSE 'overlap' END AS decision FROM part""")
def q99_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference keys, unknown fields, sample indices, area thresholds."""
    k = F.col("p_partkey")
    json = F.when(k % 3 == 0, F.to_json(F.struct(F.lit(1).alias("id"), F.lit(2).alias("extra")))).otherwise(F.to_json(F.struct(F.lit(1).alias("id"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", entities.reference_key(F.lit("geo"), F.col("p_type"), F.col("p_brand")).alias("key"), F.array_join(entities.unknown_fields(json, ["id", "name"]), ",").alias("unknown"),
        F.array_join(entities.sample_indices(F.col("p_size"), 4), ",").alias("sampled"), shapes.significant_area(F.col("p_size") * 1e-10, F.col("p_retailprice") * 1e3).alias("significant"), shapes.overlap_decision(F.col("p_size") * 1e-9).alias("decision"),
    )


@query("""
WITH v AS (SELECT o_custkey AS entity_id, count(*) AS n, min(o_orderkey) AS sole FROM orders GROUP BY 1), c AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN last ELSE c_custkey END AS asked FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal < 7000)
SELECT entity_id, CASE WHEN t THEN asked WHEN asked IS NULL AND n = 1 THEN sole END AS version_id, CASE WHEN t OR asked IS NULL AND n = 1 THEN NULL WHEN asked IS NOT NULL THEN 'unknown version' ELSE 'ambiguous' END AS issue
FROM (SELECT v.*, asked, coalesce(EXISTS (SELECT 1 FROM orders WHERE o_custkey = v.entity_id AND o_orderkey = asked), false) AS t FROM v LEFT JOIN c USING (entity_id))""")
def q100_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that stands for an undated entity."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("version_id"))
    last = versions.groupBy("entity_id").agg(F.max("version_id").alias("last"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 7000").select(F.col("c_custkey").alias("entity_id")).join(last, "entity_id", "left")
    chosen = rows.select("entity_id", F.when(F.col("entity_id") % 2 == 0, F.col("last")).otherwise(F.col("entity_id")).alias("version_id"))
    return entities.representatives(versions, chosen)


@query("SELECT c_custkey, c_custkey % 5 <> 0 AS property_only FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0")
def q101_property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that changed in free columns only."""
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    after = rows.withColumns({"c_name": F.when(k % 3 == 0, "other").otherwise(F.col("c_name")), "c_acctbal": F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))})
    return entities.only_properties_changed(rows, after, "c_custkey", ["c_name"])


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) - o_orderkey % 4 END AS a, CASE WHEN o_orderkey % 8 <> 0 THEN year(o_orderdate) END AS b FROM orders),
h AS (SELECT *, coalesce(a <= 1996, true) AND coalesce(b >= 1996, true) AS holds FROM v)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY holds DESC, CASE WHEN holds THEN a END DESC NULLS LAST, CASE WHEN NOT holds THEN abs(a - 1996) END NULLS LAST, o_orderkey) AS r FROM h) WHERE r = 1""")
def q102_geometry_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a shape for a year, or the nearest one."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_custkey", k, F.when(k % 9 != 0, y - k % 4).alias("a"), F.when(k % 8 != 0, y).alias("b"))
    return entities.geometry_version(rows, "o_custkey", "a", "b", 1996, "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"""
WITH s AS (SELECT o_custkey, o_orderkey, {_DAY.format("o_orderdate")} AS lo, {_DAY.format("o_orderdate + INTERVAL 300 DAY")} AS hi FROM orders), r AS (SELECT *, lo <= 19970331 AND hi >= 19970331 AS active FROM s)
SELECT o_custkey, o_orderkey, NOT active AS hidden, o_custkey IN (SELECT o_custkey FROM r WHERE active) AS listed, (SELECT strftime(max(o_orderdate), '%Y-%m') FROM orders) AS month FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY active DESC, o_orderkey) AS n FROM r) WHERE n = 1""")
def q103_static_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's one record at a month, who is listed then, and the month that a timeline opens at."""
    rows = table(spark, sf_dir, "orders").withColumn("_end", F.col("o_orderdate") + F.expr("interval 300 days"))
    rows = rows.select("o_custkey", "o_orderkey", day("o_orderdate").alias("lo"), day("_end").alias("hi"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"))
    listed = entities.entities_at(rows, "o_custkey", "lo", "hi", 19970331).withColumn("listed", F.lit(True))
    one = entities.static_document(rows.select("o_custkey").distinct(), rows, "o_custkey", "lo", "hi", "o_orderkey", 19970331)
    month = entities.initial_month(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"))
    out = one.join(listed, "o_custkey", "left").crossJoin(F.broadcast(month))  # one row
    return out.select("o_custkey", "o_orderkey", "hidden", F.coalesce("listed", F.lit(False)).alias("listed"), "month")


@query("""
SELECT l_orderkey AS entry, l_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AS known, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30) AS active, l_quantity >= 40 AS blank, count(*) OVER (PARTITION BY l_partkey) > 1 AS repeated FROM lineitem""")
def q104_reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the entries of a distribution (Q4)."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), "l_partkey", F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("value"))
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return entities.reference_status(entries, parts.where("p_size > 10"), parts.where("p_size > 30"), "l_partkey")


@query("""
WITH g AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT -1), h AS (SELECT DISTINCT c_custkey + 3 AS id FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0)
SELECT id, CASE WHEN id < 0 THEN 'unknown' ELSE 'removed' END AS outcome FROM g WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT id, 'referenced' FROM g WHERE id IN (SELECT id FROM h)
UNION ALL SELECT c_custkey, 'kept' FROM customer WHERE c_custkey NOT IN (SELECT id FROM g) OR c_custkey IN (SELECT id FROM h)""")
def q105_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded removal with receipts."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    gone = nodes.where("id % 3 = 0").union(spark.createDataFrame([(-1,)], "id long"))
    inbound = nodes.where("id % 4 = 0").select(F.col("id").alias("source"), (F.col("id") + 3).alias("id"))
    kept, receipts = entities.retired(nodes, gone, inbound)
    return receipts.union(kept.select("id", F.lit("kept")))


@query("""
WITH s AS (SELECT c_custkey AS id, 1 AS version, c_name AS content FROM customer WHERE c_custkey % 2 = 0)
SELECT id, version, content FROM s UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0""")
def q106_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions appended, equal ones used again, torn ones refused."""
    rows, k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("version"), F.col("c_name").alias("content")), F.col("id")
    torn = rows.where(k % 5 == 0).withColumn("content", F.lit("torn"))
    return entities.appended_versions(rows.where(k % 2 == 0), rows.where(k % 2 == 1).union(torn).union(rows.where(k % 4 == 0)))[0]


@query("SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def q107_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of evidence for each entity."""
    return entities.evidence_by_entity(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "n", F.array_join("kinds", ",").alias("kinds"))


@query(f"""
WITH n AS ({_TREE}), m AS (SELECT id, CASE WHEN id = 'n3' THEN 's1' WHEN id = 's2' THEN 'n99' ELSE p END AS p, CASE WHEN id = 's3' THEN 'town' WHEN id = 's4' THEN 'nation' ELSE kind END AS kind FROM n)
SELECT 'n3' AS id, 'parent kind' AS issue UNION ALL SELECT 's2', 'missing parent' UNION ALL SELECT 's3', 'unknown kind' UNION ALL SELECT 's4', 'parent kind'
UNION ALL SELECT * FROM (SELECT id, 'cycle' FROM m WHERE (SELECT p FROM m WHERE id = 's1') = 'n3' AND (id = 'n3' OR p = 'n3'))""")
def q108_hierarchy_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, parents and cycles of a hierarchy (Q15)."""
    nodes, i = _tree(spark, sf_dir), F.col("id")
    nodes = nodes.withColumn("parent_id", F.when(i == "n3", "s1").when(i == "s2", "n99").otherwise(F.col("parent_id"))).withColumn("kind", F.when(i == "s3", "town").when(i == "s4", "nation").otherwise(F.col("kind")))
    return entities.hierarchy_issues(nodes, {"region": [], "nation": ["region"], "supplier": ["nation"]})


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS new, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS changed, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0) AS equal, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 7 = 0) AS absent FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 7 <> 0")
def q109_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplement against its primary source (A4)."""
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return entities.supplement_diff(rows.where(k % 3 != 0), rows.where(k % 7 != 0).withColumn("c_acctbal", F.when(k % 5 == 0, -1.0).otherwise(F.col("c_acctbal"))), "c_custkey")


def _squares(parts: DataFrame, *more: str) -> DataFrame:
    """A unit square for each part on a grid of 40 columns; every third one runs clockwise."""
    k = F.col("p_partkey")
    corner = lambda dx, dy: F.struct((k % 40 + dx).cast("double").alias("x"), (F.floor(k / 40) + dy).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return parts.select(k.alias("owner"), F.when(k % 3 == 0, F.reverse(ring)).otherwise(ring).alias("ring"), *more)


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(1 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS length FROM part a JOIN part b ON (b.p_partkey = a.p_partkey + 1 AND b.p_partkey % 40 <> 0) OR b.p_partkey = a.p_partkey + 40""")
def q110_shared_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who shares a border with whom, and how long it is."""
    return shapes.shared_borders(_squares(table(spark, sf_dir, "part")))


@query("""
WITH k AS (SELECT p_partkey AS k, p_partkey % 40 AS c, p_partkey // 40 AS r FROM part), e AS (SELECT c + 0.0 AS x1, r + 0.0 AS y1, c + 1.0 AS x2, r + 0.0 AS y2 FROM k UNION ALL SELECT c, r + 1, c + 1, r + 1 FROM k UNION ALL SELECT c, r, c, r + 1 FROM k UNION ALL SELECT c + 1, r, c + 1, r + 1 FROM k)
SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1""")
def q111_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer edges of a mesh."""
    return shapes.perimeter(_squares(table(spark, sf_dir, "part")))


@query("SELECT p_partkey AS owner, p_partkey % 3 <> 0 AS was, true AS now, CAST(1 AS DOUBLE) AS area, 0.25 + p_size / 50 <= 1 AS holds, false AS held, CAST(5 AS INTEGER) AS positions, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'open' WHEN 2 THEN 'repeated' ELSE 'flat,crossing' END AS issues, p_partkey % 5 <> 0 AS equal FROM part")
def q112_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winding, containment, statistics, issues and equality of rings."""
    ring, k = F.col("ring"), F.col("owner")
    x0, y0 = ring[0]["x"], ring[0]["y"]
    p = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    small = F.array(p(0.25, 0.25), p(0.5, 0.25), p(0.5, 0.5), p(0.25, 0.25))
    across = F.array(p(0.25, 0.25), p(0.25 + F.col("p_size") / 50, 0.25), p(0.5, 0.5), p(0.25, 0.25))
    bow = F.array(p(0.0, 0.0), p(1.0, 1.0), p(1.0, 0.0), p(0.0, 1.0), p(0.0, 0.0))
    odd = F.when(k % 4 == 0, ring).when(k % 4 == 1, F.slice(ring, 1, 4)).when(k % 4 == 2, F.concat(F.slice(ring, 1, 1), ring)).otherwise(bow)
    moved = F.transform(ring, lambda v: F.struct((v["x"] + F.when(k % 5 == 0, 1e-9).otherwise(0.0)).alias("x"), v["y"].alias("y")))
    # A table of some large row groups is read by as few tasks.
    rows = _squares(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), "p_size")
    return rows.select(
        "owner", shapes.is_wound(ring).alias("was"), shapes.is_wound(shapes.wound(ring)).alias("now"), F.abs(signed_area(ring)).alias("area"),
        shapes.contains(ring, across).alias("holds"), shapes.contains(small, ring).alias("held"), shapes.polygon_statistics(F.array(F.array(ring)))["positions"].alias("positions"),
        F.array_join(shapes.ring_issues(odd), ",").alias("issues"), shapes.equal_within(ring, moved).alias("equal"),
    )


@query(f"""
WITH p AS ({_RING})
SELECT id, CAST(2 + CASE WHEN abs(v[4]) / 10 > 0.3 THEN 1 ELSE 0 END AS INTEGER) AS n FROM p""")
def q113_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without vertices that hardly matter (G33): the middle of three is kept if it is far enough off."""
    off = F.round(F.col("embedding")[3].cast("double") * 40, 4) / 10
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.array(at(0, F.lit(0.0)), at(5, off), at(10, F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size(shapes.simplified(line, 0.3)).alias("n"))


@query("""
WITH s AS (SELECT o_orderkey AS k, o_custkey, o_orderkey % 5 AS i, o_orderkey % 7 <> 3 AS inside FROM orders),
r AS (SELECT o_custkey, k, lag(k) OVER (PARTITION BY o_custkey ORDER BY k) AS b FROM s WHERE inside),
l AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND b = k - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY k) AS line_no FROM r)
SELECT o_custkey, CAST(line_no AS BIGINT) AS line_no, CAST(count(*) + 1 AS INTEGER) AS points FROM l GROUP BY o_custkey, line_no""")
def q114_clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped segments joined into lines."""
    k = F.col("o_orderkey")
    part = F.struct(k.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (k + 1).cast("double").alias("x2"), F.lit(0.0).alias("y2"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", k, F.when(k % 7 != 3, part).alias("part"))
    return shapes.clipped_lines(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "line_no", F.size("points").alias("points"))
