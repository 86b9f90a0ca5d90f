"""Queries over compiled slices, gathered payloads and library searches, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.operators import compile
from terrachron.plans.proofs import _LAT, _LON, points
from terrachron.plans.queries import query
from terrachron.sources.tables import table

_RECORDS = "SELECT o_custkey AS object_id, o_orderkey AS ord, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS lo, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) + 400 AS hi FROM orders"


@query(f"""
WITH RECURSIVE r AS ({_RECORDS}), l AS (SELECT * FROM r WHERE ord % 4 <> 0), g AS (SELECT *, ord AS geom_id FROM r WHERE ord % 3 <> 0), p AS (SELECT *, object_id // 2 AS parent_id FROM r WHERE ord % 5 = 0 AND object_id > 1),
b AS (SELECT object_id, lo AS t FROM l UNION SELECT object_id, hi FROM l UNION SELECT object_id, lo FROM g UNION SELECT object_id, hi FROM g UNION SELECT object_id, lo FROM p UNION SELECT object_id, hi FROM p),
c AS (SELECT * FROM (SELECT object_id, t AS lo, lead(t) OVER (PARTITION BY object_id ORDER BY t) AS hi FROM b) WHERE hi IS NOT NULL),
a AS (SELECT c.object_id, c.lo, c.hi, arg_min(g.geom_id, g.ord) AS geom_id FROM c JOIN g ON g.object_id = c.object_id AND g.lo <= c.lo AND g.hi >= c.hi WHERE EXISTS (SELECT 1 FROM l WHERE l.object_id = c.object_id AND l.lo <= c.lo AND l.hi >= c.hi) GROUP BY ALL),
s AS (SELECT a.*, (SELECT arg_min(p.parent_id, p.ord) FROM p WHERE p.object_id = a.object_id AND p.lo <= a.lo AND p.hi >= a.hi) AS parent_id FROM a),
t AS (SELECT * FROM s WHERE parent_id IS NULL UNION ALL SELECT s.object_id, greatest(s.lo, t.lo), least(s.hi, t.hi), s.geom_id, s.parent_id FROM s JOIN t ON s.parent_id = t.object_id AND s.lo < t.hi AND t.lo < s.hi)
SELECT * FROM t""")
def q115_compiled_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a dated world in which all above an object is there too."""
    lo = F.unix_date(F.to_date("o_orderdate")).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("ord"), lo.alias("lo"), (lo + 400).alias("hi"))
    parents = rows.where("ord % 5 = 0 and object_id > 1").withColumn("parent_id", F.floor(F.col("object_id") / 2).cast("long"))
    return compile.compile_world(rows.where("ord % 4 <> 0"), rows.where("ord % 3 <> 0").withColumn("geom_id", F.col("ord")), parents)


@query("""
WITH r AS (SELECT o_custkey AS entity_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0),
w AS (SELECT entity_id FROM r GROUP BY entity_id HAVING bool_and(k % 11 <> 0))
SELECT entity_id, string_agg(o_orderpriority, ',' ORDER BY n) AS payloads FROM r JOIN w USING (entity_id) JOIN orders ON o_orderkey = k GROUP BY entity_id""")
def q116_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with all their payloads in order."""
    orders = table(spark, sf_dir, "orders")
    refs = orders.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.lit(1).alias("version")))).alias("refs"))
    payloads = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_orderpriority").alias("payload"))
    return compile.materialised(refs, payloads)[0].select("entity_id", F.array_join("payloads", ",").alias("payloads"))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND (contains(lower(p_name), 'large') OR contains(lower(p_brand), 'large'))")
def q117_library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries of a kind by any of their names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"), F.array("p_brand", "p_name").alias("names"))
    return compile.library_search(rows, "names", " LARGE ", kind="ECONOMY").select("p_partkey")


@query("""
WITH n AS (SELECT DISTINCT p_size AS g, p_name AS name FROM part), t AS (SELECT DISTINCT p_size AS g, split_part(p_name, ' ', 1) AS token FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_size, 'rare' FROM part WHERE p_size % 7 = 0)
SELECT g AS "group", bool_and(EXISTS (SELECT 1 FROM n WHERE n.g = t.g AND contains(n.name, t.token))) AS present FROM t GROUP BY g""")
def q118_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all tokens of a group are part of some name (P20)."""
    rows = table(spark, sf_dir, "part")
    names = rows.select(F.col("p_size").alias("group"), F.col("p_name").alias("name")).distinct()
    tokens = rows.where("p_partkey % 2 = 0").select(F.col("p_size").alias("group"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token")).union(rows.where("p_size % 7 = 0").select("p_size", F.lit("rare"))).distinct()
    return compile.presence(tokens, names)


@query(f"""
WITH p AS (SELECT vec_id AS id, {_LON} AS x, {_LAT} AS y, cos(radians({_LAT})) AS c FROM embeddings), s AS (SELECT *, greatest(0.0, least(1.0, ((x * c - -10 * c) * 20 * c + (y - -5) * 10) / (400 * c * c + 100))) AS t FROM p)
SELECT id, round(111.195 * sqrt(pow(x * c - -10 * c - t * 20 * c, 2) + pow(y - -5 - t * 10, 2)), 5) AS km FROM s""")
def q119_local_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres from points to a segment."""
    km = compile.local_segment_km(F.col("lon"), F.col("lat"), *map(F.lit, (-10.0, -5.0, 10.0, 5.0)))
    return points(spark, sf_dir).select("id", F.round(km, 5).alias("km"))
