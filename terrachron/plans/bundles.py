"""Queries over names, library records, manifests and packed tiles, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.functions import names
from terrachron.operators import bundles, packs
from terrachron.plans.queries import query
from terrachron.sources.tables import table

_DAYS = "CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT)"


def _epoch_days(c: str):
    return F.unix_date(F.to_date(c)).cast("long")


@query(r"""
WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Ward' WHEN 1 THEN ' industrial zone' WHEN 2 THEN '-DONG' WHEN 3 THEN ' 서초구' WHEN 4 THEN ' wards' ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'JP' ELSE 'KR' END AS country FROM part)
SELECT p_partkey, regexp_matches(name, '(?i)\b(neighbou?rhood|borough|suburb|district|ward|arrondissement|quarter|campus|airport|station|hospital|university|industrial zone)\b') AS part_of_town, country = 'KR' AND (ends_with(lower(name), '-dong') OR ends_with(name, '구')) AS micro FROM n""")
def q120_name_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts of towns and of small administrative units."""
    k = F.col("p_partkey")
    tail = F.when(k % 6 == 0, " Ward").when(k % 6 == 1, " industrial zone").when(k % 6 == 2, "-DONG").when(k % 6 == 3, " 서초구").when(k % 6 == 4, " wards").otherwise("")
    name = F.concat("p_name", tail)
    return table(spark, sf_dir, "part").select(k, names.part_of_town(name).alias("part_of_town"), names.micro_unit(name, F.when(k % 5 == 0, "JP").otherwise("KR")).alias("micro"))


@query("SELECT c_custkey, c_name, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AS reused FROM customer WHERE c_custkey % 7 <> 0")
def q121_reused_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their geometry where an equal one was there before."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array(F.col("c_acctbal")).alias("shape"))
    after = rows.where("c_custkey % 7 <> 0").withColumn("shape", F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit(1e9))).otherwise(F.col("shape")))
    return bundles.reused_payloads(rows.where("c_custkey % 3 <> 0"), after, "c_custkey", "shape")


@query("""
WITH RECURSIVE p AS (SELECT p_partkey % 40 AS shard, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS i, p_partkey // 40 * 40000 + p_size * 100 AS "offset", 20000 + CAST(p_size AS BIGINT) * 50 AS length FROM part),
g AS (SELECT shard, i, "offset", length, "offset" AS start, "offset" + length AS e FROM p WHERE i = 1
 UNION ALL SELECT p.shard, p.i, p."offset", p.length, CASE WHEN p."offset" - g.e > 32768 OR p."offset" + p.length - g.start > 1048576 THEN p."offset" ELSE g.start END, CASE WHEN p."offset" - g.e > 32768 OR p."offset" + p.length - g.start > 1048576 THEN p."offset" + p.length ELSE greatest(g.e, p."offset" + p.length) END FROM g JOIN p ON p.shard = g.shard AND p.i = g.i + 1)
SELECT shard, "offset", length, start FROM g""")
def q122_coalesced_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of neighbouring packs put together (K6)."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return packs.coalesced_reads(table(spark, sf_dir, "part").select((k % 40).alias("shard"), (F.floor(k / 40) * 40000 + size * 100).alias("offset"), (size * 50 + 20000).alias("length")))


@query("SELECT DISTINCT l_orderkey AS logical_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity * 1000000 <= 20000000 AND l_quantity * 1000000 + 2000000 >= 12000000 AND l_discount * 1000000 <= 60000 AND l_discount * 1000000 + 10000 >= 30000")
def q123_features_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical features of a category that meet a box (K7)."""
    w, s = F.round(F.col("l_quantity") * 1000000).cast("long"), F.round(F.col("l_discount") * 1000000).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("logical_id"), F.col("l_returnflag").alias("category"), w.alias("w"), s.alias("s"), (w + 2000000).alias("e"), (s + 10000).alias("n"))
    return packs.features_in_box(rows, "R", 12.0, 0.03, 20.0, 0.06)


@query("""
WITH t AS (SELECT p_partkey % 10 AS col, p_partkey // 10 AS row, (SELECT max(p_partkey) // 10 + 1 FROM part) AS rows FROM part)
SELECT col, row, 'east' AS side FROM t WHERE (row * 10 + col) % 7 = 3 OR (row * 10 + (col + 1) % 10) % 7 = 3
UNION ALL SELECT col, row, 'south' FROM t WHERE row < rows - 1 AND ((row * 10 + col) % 7 = 3 OR (row * 10 + col + 10) % 7 = 3)
UNION ALL SELECT col, row, 'top' FROM t WHERE row = 0 AND col = 3 UNION ALL SELECT col, row, 'bottom' FROM t WHERE row = rows - 1 AND (row * 10 + col) % 7 = 3""")
def q124_tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that differ from their neighbours at an edge (K9): each seventh one has pixels of its own."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    rows = parts.agg(F.max("p_partkey")).first()[0] // 10 + 1
    # Pixels of a level 20 wide: a tile of 2 x 2 with a border of one, rows clamped and columns in a ring.
    x, y = (lambda dx: (k % 10 * 2 + dx + 20) % 20), (lambda dy: F.least(F.greatest(F.floor(k / 10) * 2 + dy, F.lit(0)), F.lit(rows * 2 - 1)))
    pixels = F.array(*(F.when(k % 7 == 3, -k * 16 - 4 * j - i - 1).otherwise(y(j - 1) * 20 + x(i - 1)) for j in range(4) for i in range(4)))
    tiles = parts.select((k % 10).alias("col"), F.floor(k / 10).alias("row"), F.lit(4).alias("width"), F.lit(4).alias("height"), pixels.alias("data"))
    return packs.edge_mismatches(tiles, 10, rows)


_OUTPUT = "SELECT p_partkey AS id, 10 + p_size AS n, (p_partkey % 16 + 0.5) * (CAST(10 + p_size AS DOUBLE) / 16) AS c, greatest(1.0, CAST(10 + p_size AS DOUBLE) / 16) AS f FROM part"


def _weights(kind: str, radius: int, lobe: str) -> str:
    return f"""SELECT id, '{kind}' AS kind, s, j, {lobe} AS v FROM (SELECT id, s, j, abs((j - c + 0.5) / f) AS x
FROM (SELECT id, c, f, s, unnest(range(s, e)) AS j FROM (SELECT id, c, f, greatest(0, CAST(trunc(c - {radius} * f + 0.5) AS BIGINT)) AS s, least(n, CAST(trunc(c + {radius} * f + 0.5) AS BIGINT)) AS e FROM o)))"""


@query(f"""
WITH o AS ({_OUTPUT}), w AS ({_weights("bilinear", 1, "greatest(0.0, 1 - x)")} UNION ALL {_weights("bicubic", 2, "CASE WHEN x < 1 THEN (1.5 * x - 2.5) * x * x + 1 WHEN x < 2 THEN ((-0.5 * x + 2.5) * x - 4) * x + 2 ELSE 0 END")}), t AS (SELECT *, sum(v) OVER (PARTITION BY id, kind) AS total FROM w)
SELECT id, kind, CAST(s AS INTEGER) AS start, string_agg(CAST(round(v / total * 4194304) AS BIGINT), ',' ORDER BY j) AS weights FROM t GROUP BY id, kind, s""")
def q125_resample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each input pixel gives to an output pixel (K25; the third kind is tested by values)."""
    k, n = F.col("p_partkey"), F.col("p_size") + 10
    rows = table(spark, sf_dir, "part").select(k.alias("id"), *(packs.resample_weights(n, F.lit(16), k % 16, kind).alias(kind) for kind in ("bilinear", "bicubic")))
    rows = rows.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("w")) for c in ("bilinear", "bicubic")))).alias("v"))
    return rows.select("id", "v.kind", "v.w.start", F.array_join(F.col("v.w.weights").cast("array<string>"), ",").alias("weights"))


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '한강' WHEN 1 THEN '큰내강' WHEN 2 THEN '충주호' WHEN 3 THEN 'Red' WHEN 4 THEN '섬진강' WHEN 5 THEN '' WHEN 6 THEN '미명명 수계 7' ELSE 'Long Lake Dam' END AS hydronym FROM part""")
def q126_hydronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of waters in one form."""
    k = F.col("p_partkey")
    given = F.when(k % 8 == 0, " 한  강강").when(k % 8 == 1, "큰 내").when(k % 8 == 2, "충주").when(k % 8 == 3, "Red\tRIVER").when(k % 8 == 4, "Seomjin").when(k % 8 == 5, " \t").when(k % 8 == 6, "미명명 수계 7").otherwise("Long  Lake Dam")
    rows = table(spark, sf_dir, "part").select(k, given.alias("name"), F.when(k % 8 == 2, "lake").otherwise("river").alias("category"))
    aliases = spark.createDataFrame([("Seomjin", "섬진 강")], "alias string, name string")
    return bundles.hydronyms(rows, aliases, "name", "category").select("p_partkey", "hydronym")


@query("""
WITH c AS (SELECT p_size AS system, p_partkey % 4 AS rank, CASE WHEN p_size % 9 = 0 OR p_partkey % 3 = 0 THEN '' ELSE p_name || p_partkey % 5 END AS name FROM part),
b AS (SELECT system, arg_min(name, (rank, name)) FILTER (WHERE name <> '') AS best, list_sort(list_distinct(list(name) FILTER (WHERE name <> ''))) AS a FROM c GROUP BY system)
SELECT system, coalesce(best, '미명명 수계 ' || system) AS name, best IS NOT NULL AS named, coalesce(array_to_string(list_filter(a, lambda x: x <> best), ','), '') AS others FROM b""")
def q127_system_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best name of each system of waters and its other names."""
    k = F.col("p_partkey")
    name = F.when((F.col("p_size") % 9 == 0) | (k % 3 == 0), "").otherwise(F.concat("p_name", (k % 5).cast("string")))
    found = bundles.system_names(table(spark, sf_dir, "part").select(F.col("p_size").alias("system"), (k % 4).alias("rank"), name.alias("name")))
    return found.withColumn("others", F.array_join("others", ","))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'gis' WHEN 1 THEN 'user' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'user' ELSE 'plugin' END AS kind, array_to_string(list_filter(json_keys(props), lambda x: x NOT IN ('dataset', 'version')), ',') AS rest FROM events""")
def q128_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of sources, and fields that a record has no place for."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, " gis ").when(k % 5 == 1, "").when(k % 5 == 2, "GIS").when(k % 5 == 4, "plugin")
    fields = F.map_concat(F.create_map(F.lit("dataset"), F.col("event_type")), F.transform_values(F.from_json("props", "map<string,string>"), lambda _, v: v))
    return table(spark, sf_dir, "events").select("event_id", names.source_kind(kind, F.lit("user")).alias("kind"), F.array_join(F.map_keys(names.unmapped(fields, ["dataset", "version"])), ",").alias("rest"))


@query("SELECT p_partkey, p_partkey % 9 IN (0, 5) AS valid FROM part")
def q129_valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilingual names that hold to their shape."""
    k = F.col("p_partkey")
    texts = [
        '{"ko": {"common": "강", "aliases": ["a", "b"]}, "native": [{"language": "fr-CA", "formal": "x"}]}', '{"ko": {"common": " "}}', '{"ko": {"common": "a", "aliases": ["b", "b"]}}',
        '{"native": [{"formal": "x"}]}', '{"native": []}', '{"en": {"formal": "x"}}', '{"fr": {"common": "x"}}', '{"native": [{"language": "fr", "common": "x"}, {"language": "fr", "common": "y"}]}',
    ]
    given = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        given = F.when(k % 9 == i, text).otherwise(given)
    return table(spark, sf_dir, "part").select(k, names.valid_names(given).alias("valid"))


@query(f"""
WITH v AS (SELECT o_custkey AS entity_id, o_orderkey AS k, {_DAYS} AS lo, {_DAYS} + 300 AS hi, o_orderpriority AS name FROM orders),
a AS (SELECT entity_id, arg_max(name, (lo, name)) FILTER (WHERE lo <= 10000 AND hi >= 10000) AS name FROM v GROUP BY entity_id),
s AS (SELECT entity_id, name, min((lo, name)) AS f FROM v GROUP BY entity_id, name), l AS (SELECT entity_id, string_agg(name, ',' ORDER BY f) AS search_names FROM s GROUP BY entity_id)
SELECT * FROM a JOIN l USING (entity_id)""")
def q130_names_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each entity at a day and all names that it had."""
    lo = _epoch_days("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), lo.alias("lo"), (lo + 300).alias("hi"), F.col("o_orderpriority").alias("name"), F.array("o_orderpriority").alias("names"))
    return bundles.names_at(rows, 10000).withColumn("search_names", F.array_join("search_names", ","))


@query(f"""
WITH v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN {_DAYS} END AS lo, CASE WHEN o_orderkey % 6 <> 0 THEN {_DAYS} + 300 END AS hi FROM orders),
l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 9000 + c_custkey % 500 END AS born, CASE WHEN c_custkey % 4 <> 0 THEN 10500 END AS died FROM customer)
SELECT o_orderkey, o_custkey, greatest(lo, born) AS lo, least(hi, died) AS hi FROM v JOIN l ON o_custkey = c_custkey WHERE coalesce(greatest(lo, born) <= least(hi, died), true)""")
def q131_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated names cut to the lifetimes of their entities."""
    k, lo, c = F.col("o_orderkey"), _epoch_days("o_orderdate"), F.col("c_custkey")
    versions = table(spark, sf_dir, "orders").select(k, "o_custkey", F.when(k % 5 != 0, lo).alias("lo"), F.when(k % 6 != 0, lo + 300).alias("hi"))
    lives = table(spark, sf_dir, "customer").select(c.alias("o_custkey"), F.when(c % 3 != 0, c % 500 + 9000).alias("born"), F.when(c % 4 != 0, F.lit(10500).cast("long")).alias("died"))
    return bundles.bindings(versions, lives, "o_custkey")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'red' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def q132_active_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the names and colours of a month."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, "c_name", "c_mktsegment")
    name = rows.where(k % 3 == 0).select(k, F.lit("name").alias("property"), F.concat(F.lit("n"), k.cast("string")).alias("value"))
    colour = rows.where(k % 5 == 0).select(k, F.lit("color").alias("property"), F.lit("red").alias("value"))
    return bundles.with_active_properties(rows, name.union(colour), "c_custkey", {"c_name": "name", "c_mktsegment": "color"})


@query(f"""
WITH r AS (SELECT o_orderkey AS id, o_custkey AS o, {_DAYS} AS lo, {_DAYS} + o_orderkey % 90 AS hi FROM orders), l AS (SELECT * FROM r WHERE id % 3 <> 0), g AS (SELECT * FROM r WHERE id % 2 = 0), p AS (SELECT *, CASE WHEN id % 10 = 4 THEN o ELSE o // 2 END AS p FROM r WHERE id % 5 = 4),
m AS (SELECT o, lo, hi, t, sum(CASE WHEN lo <= h + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY t, o ORDER BY lo, id) AS i FROM (SELECT *, max(hi) OVER (PARTITION BY t, o ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM (SELECT *, 'l' AS t FROM l UNION ALL SELECT *, 'g' FROM g))),
c AS (SELECT t, o, i, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY t, o, i), lc AS (SELECT * FROM c WHERE t = 'l'), gc AS (SELECT * FROM c WHERE t = 'g'),
v AS (SELECT id, lo, max(hi) OVER (PARTITION BY t, o ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM (SELECT id, o, lo, hi, 1 AS t FROM l UNION ALL SELECT id, o, lo, hi, 2 FROM g UNION ALL SELECT id, o, lo, hi, 3 FROM p))
SELECT CAST(id AS VARCHAR) AS id, 'overlap' AS issue FROM v WHERE lo <= h
UNION ALL SELECT CAST(id AS VARCHAR), 'outside lifetime' FROM (SELECT id, o, lo, hi FROM g UNION ALL SELECT id, o, lo, hi FROM p) x WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.o = x.o AND lc.lo <= x.lo AND lc.hi >= x.hi)
UNION ALL SELECT DISTINCT CAST(o AS VARCHAR), 'gap' FROM lc WHERE NOT EXISTS (SELECT 1 FROM gc WHERE gc.o = lc.o AND gc.lo <= lc.lo AND gc.hi >= lc.hi)
UNION ALL SELECT CAST(id AS VARCHAR), 'inactive parent' FROM p WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.o = p.p AND lc.lo <= p.lo AND lc.hi >= p.hi)
UNION ALL SELECT CAST(id AS VARCHAR), 'cycle' FROM p WHERE p = o""")
def q133_record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps, gaps, records outside lifetimes and inactive parents of dated records (T19; cycles of one object)."""
    k, o, lo = F.col("o_orderkey"), F.col("o_custkey"), _epoch_days("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), o.alias("object_id"), lo.alias("lo"), (lo + k % 90).alias("hi"))
    parent = F.when(F.col("id") % 10 == 4, F.col("object_id")).otherwise(F.floor(F.col("object_id") / 2))
    return bundles.record_issues(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0"), rows.where("id % 5 = 4").withColumn("parent_id", parent))


@query("""
WITH e AS (SELECT s_suppkey AS e, CASE WHEN s_suppkey = 5 THEN 4 WHEN s_suppkey = 4 THEN 5 WHEN s_suppkey = 7 THEN -1 END AS p FROM supplier)
SELECT CAST(e AS VARCHAR) AS id, 'no lineage' AS issue FROM e WHERE e % 8 = 6 UNION ALL SELECT CAST(e AS VARCHAR), 'member twice' FROM e WHERE e % 8 = 1
UNION ALL SELECT CAST(e AS VARCHAR), 'other lineage' FROM e WHERE e % 8 = 2 UNION ALL SELECT '-3', 'unknown member' UNION ALL SELECT '-2', 'missing end'
UNION ALL SELECT '7', 'missing parent' UNION ALL SELECT '4', 'cycle' UNION ALL SELECT '5', 'cycle' UNION ALL SELECT '0', 'duplicate entity'""")
def q134_lineage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, relations and parents of a library's index (Q6)."""
    k = F.col("s_suppkey")
    parent = F.when(k == 5, 4).when(k == 4, 5).when(k == 7, -1).cast("long")
    entities = table(spark, sf_dir, "supplier").select(k.alias("entity_id"), F.col("s_nationkey").alias("lineage_id"), parent.alias("parent_id"))
    e = F.col("entity_id")
    members = entities.where(e % 8 != 6).select(F.when(e % 8 == 2, -1).otherwise(F.col("lineage_id")).alias("lineage_id"), "entity_id")
    members = members.union(members.where(e % 8 == 1)).union(members.where(e == 0).select("lineage_id", F.lit(-3).cast("long")))
    relations = entities.select(e.alias("source"), F.when(e % 9 == 0, -2).otherwise(e).cast("long").alias("target"))
    return bundles.lineage_issues(entities.union(entities.where("entity_id = 0")), members, relations)


@query("""
WITH t AS (SELECT p_partkey AS k, p_partkey % 7 AS m FROM part)
SELECT CAST(k AS VARCHAR) AS id, 'missing shard' AS issue FROM t WHERE m = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'range' FROM t WHERE m IN (1, 2) UNION ALL SELECT CAST(k AS VARCHAR), 'hash' FROM t WHERE k % 5 IN (0, 1) UNION ALL SELECT CAST(k AS VARCHAR), 'order' FROM t WHERE k % 4 = 0""")
def q135_manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, hashes and page orders of a manifest (Q7)."""
    k = F.col("p_partkey")
    sha = F.sha2(k.cast("string"), 256)
    tiles = table(spark, sf_dir, "part").select(
        k.alias("key"), F.when(k % 7 == 0, -1).otherwise(k % 10).alias("shard"), F.when(k % 7 == 1, 990).otherwise(100).alias("offset"), F.when(k % 7 == 2, 31).otherwise(32).alias("length"),
        F.when(k % 5 == 0, F.upper(F.concat(F.lit("A"), F.substring(sha, 2, 63)))).when(k % 5 == 1, F.lit(None)).otherwise(sha).alias("sha256"), F.when(k % 4 == 0, "b").otherwise("a").alias("first"), F.when(k % 4 == 1, F.lit(None)).otherwise("a").alias("last"),
    )
    return bundles.manifest_issues(tiles, spark.range(10).select(F.col("id").alias("shard"), F.lit(1000).alias("bytes")))


@query("""
WITH f AS (SELECT s_nationkey AS s, s_suppkey AS k FROM supplier UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 11 = 0), g AS (SELECT s, count(*) AS f, count(DISTINCT k) AS i FROM f GROUP BY s), d AS (SELECT s_nationkey AS s, count(*) AS n FROM supplier GROUP BY s_nationkey UNION ALL SELECT -1, 0 UNION ALL SELECT -2, 3)
SELECT d.s AS source, d.n, coalesce(f, 0) AS features, coalesce(i, 0) AS ids, coalesce(f, 0) = n AND coalesce(i, 0) = n AS consistent FROM d LEFT JOIN g ON g.s = d.s""")
def q136_source_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and ids of each source against their declared number (Q16)."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    declared = rows.groupBy(F.col("s_nationkey").alias("source")).agg(F.count("*").alias("n")).union(spark.createDataFrame([(-1, 0), (-2, 3)], "source int, n long"))
    return bundles.source_consistency(rows.union(rows.where("s_suppkey % 11 = 0")), declared, "s_nationkey", "s_suppkey")


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey % 3, o_orderpriority, o_orderstatus, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END, ''), lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS INTEGER) AS position FROM orders""")
def q137_review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each change in its entity's history of reviews."""
    k = F.col("o_orderkey")
    text = F.lpad(k.cast("string"), 9, "0")
    rows = table(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("created_at"), (k % 3).alias("proposal_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("field"), F.when(k % 4 != 0, text).alias("valid_from"), text.alias("valid_to"))
    return bundles.review_history(rows).select("o_orderkey", "position")


@query("""
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 9 THEN p_partkey + 1 END AS nxt, CASE WHEN p_partkey % 25 <> 24 THEN p_partkey // 50 % 4 END AS stage, p_size AS c FROM part),
s AS (SELECT * FROM r WHERE stage IS NOT NULL), l AS (SELECT a.id, a.nxt FROM s a JOIN s b ON b.id = a.nxt AND a.stage = b.stage)
SELECT (SELECT count(*) FROM s) AS reaches, (SELECT count(*) FROM s WHERE id NOT IN (SELECT nxt FROM l)) AS chains, (SELECT CAST(sum(c) AS BIGINT) FROM s) AS coordinates""")
def q138_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaches, chains and coordinates of the reaches that have a stage."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 10 != 9, k + 1).alias("next"), F.when(k % 25 != 24, F.floor(k / 50) % 4).alias("stage"), F.col("p_size").alias("coordinates"), k.alias("position"))
    return bundles.chain_counts(rows)


@query("SELECT o_custkey, string_agg(o_orderkey || ',' || (o_orderkey + 1), ',' ORDER BY o_orderkey) AS polygons FROM orders GROUP BY o_custkey")
def q139_composed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons of all parts of a water in order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", k, F.array(k, k + 1).alias("polygons"))
    return bundles.composed_polygons(rows, "o_custkey", ["o_orderkey"], "polygons").withColumn("polygons", F.array_join(F.col("polygons").cast("array<string>"), ","))
