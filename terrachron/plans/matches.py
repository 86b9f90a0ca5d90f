"""Matching, connectivity and calibration operators applied to the supplied tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.operators import calibration, graph, matching, spatial, terrain
from terrachron.plans.queries import query
from terrachron.sources.tables import table

_XY = "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 300, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 150, 3) AS y FROM embeddings"


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * 300, 3).alias("x"), F.round(e[1].cast("double") * 150, 3).alias("y"))


@query(f"""
WITH p AS ({_XY}), s AS (SELECT id, x AS x1, y AS y1, x + 6 AS x2, y + 2 AS y2 FROM p),
j AS (SELECT p.id, x - x1 AS px, y - y1 AS py, x2 - x1 AS dx, y2 - y1 AS dy FROM p JOIN s ON p.id <> s.id),
t AS (SELECT *, greatest(0.0, least(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM j),
d AS (SELECT id, sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) AS distance FROM t)
SELECT id, round(min(distance), 6) AS distance FROM d WHERE distance <= 1.5 GROUP BY id""")
def q36_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest other segment within 1.5 degrees is."""
    points = _xy(spark, sf_dir)
    segments = points.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 6).alias("x2"), (F.col("y") + 2).alias("y2"))
    found = matching.near_segments(points, segments, 1.5).where("id <> segment")
    return found.groupBy("id").agg(F.round(F.min("distance"), 6).alias("distance"))


@query(f"""
WITH p AS ({_XY}), b AS (SELECT id, x - 2 AS w, y - 1 AS s, x + 2 AS e, y + 1 AS n FROM p),
o AS (SELECT a.id AS a_id, b.id AS b_id, greatest(0, least(a.e, b.e) - greatest(a.w, b.w)) * greatest(0, least(a.n, b.n) - greatest(a.s, b.s)) AS c FROM b a JOIN b ON a.id <> b.id AND a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n),
i AS (SELECT a_id, b_id, round(c / (16 - c), 6) AS score FROM o),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM i WINDOW w AS (PARTITION BY a_id ORDER BY score DESC, b_id DESC))
SELECT a_id, b_id, score FROM r WHERE k = 1 AND (next IS NULL OR score - next >= 0.15)""")
def q37_clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other box that overlaps each box best, where none comes near it."""
    boxes = _xy(spark, sf_dir).select("id", (F.col("x") - 2).alias("w"), (F.col("y") - 1).alias("s"), (F.col("x") + 2).alias("e"), (F.col("y") + 1).alias("n"))
    pairs = spatial.boxes_join(boxes, boxes, 4.0, sides_too=True).where("a_id <> b_id")
    iou = matching.box_iou(*(F.col(f"{side}{c}") for side in "ab" for c in "wsen"))
    return matching.clear_winners(pairs.select("a_id", "b_id", F.round(iou, 6).alias("score")), "a_id", "b_id", "score", 0.15)


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 AND p_size % 3 <> 0 THEN p_partkey // 2 END AS p FROM part),
t AS (SELECT id, id AS component FROM n WHERE p IS NULL UNION ALL SELECT n.id, t.component FROM n JOIN t ON n.p = t.id)
SELECT id, component FROM t""")
def q38_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected parts of a graph: parts linked with that of half their key."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(key.alias("id"), "p_size")
    links = parts.where("id > 1 and p_size % 3 <> 0").select(F.col("id").alias("a"), F.floor(F.col("id") / 2).cast("long").alias("b"))
    return graph.connected(parts, links)


@query("""
WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1), c AS (SELECT c_custkey AS k, max(c_nationkey) AS ordinal FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT k, CASE WHEN n > 1 THEN 'invalid' WHEN n IS NULL THEN 'keep' WHEN ordinal IS NULL THEN 'insert' ELSE 'update' END AS action, ordinal FROM n FULL JOIN c USING (k)""")
def q39_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of late orders' customers would do to the solvent ones."""
    new = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '2001-01-01'").select(F.col("o_custkey").alias("k"))
    old = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("ordinal"))
    return matching.merge_plan(new, old, "k", "ordinal")


@query("""
SELECT p_brand, stage, count(*) FILTER (WHERE p_retailprice >= t) AS n, round(coalesce(sum(p_size) FILTER (WHERE p_retailprice >= t), 0)::DOUBLE, 6) AS length, round(coalesce(sum(p_size) FILTER (WHERE p_retailprice >= t), 0)::DOUBLE / sum(p_size), 9) AS share
FROM part, (VALUES (0, 1800.0), (1, 1500.0), (2, 1200.0), (3, 0.0)) v(stage, t) GROUP BY p_brand, stage""")
def q40_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four thresholds select from each brand."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", F.col("p_size").cast("double").alias("length"))
    found = calibration.stage_metrics(rows, ["p_brand"], "p_retailprice", "length", [1800.0, 1500.0, 1200.0, 0.0])
    return found.select("p_brand", "stage", "n", F.round("length", 6).alias("length"), F.round("share", 9).alias("share"))


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 4))) * 100 AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2""")
def q41_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that don't depend on the order of rows."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(calibration.exact_sum(F.col("l_extendedprice"), 4).alias("s"))
    return found.select("l_returnflag", "l_linestatus", (F.col("s") * 100).cast("long").alias("cents"))


@query("""
WITH t AS (SELECT DISTINCT l_partkey % 97 AS tx, l_suppkey AS ty FROM lineitem WHERE l_quantity > 30)
SELECT tx, ty, NOT EXISTS (FROM t b WHERE b.tx = t.tx - 1 AND b.ty = t.ty) AS no_west, NOT EXISTS (FROM t b WHERE b.tx = t.tx + 1 AND b.ty = t.ty) AS no_east, NOT EXISTS (FROM t b WHERE b.tx = t.tx AND b.ty = t.ty - 1) AS no_north, NOT EXISTS (FROM t b WHERE b.tx = t.tx AND b.ty = t.ty + 1) AS no_south FROM t""")
def q42_missing_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which sides a tile has no neighbour."""
    return terrain.missing_sides(table(spark, sf_dir, "lineitem").where("l_quantity > 30").select((F.col("l_partkey") % 97).alias("tx"), F.col("l_suppkey").alias("ty")))


@query("""
SELECT user_id, event_id, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 25.0) AS INTEGER) AS batch FROM events""")
def q43_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in batches of 25."""
    return matching.batches(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 25).drop("ts")


@query("""
WITH p AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 300, 3) AS lon, round(CAST(embedding[2] AS DOUBLE) * 150, 3) AS lat FROM embeddings),
b AS (SELECT id, lon - 1 AS w, lat - 1 AS s, lon + 1 AS e, lat + 1 AS n FROM p)
SELECT p.id AS a_id, b.id AS b_id FROM p JOIN b ON p.lon BETWEEN b.w AND b.e AND p.lat BETWEEN b.s AND b.n""")
def q44_box_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the boxes around all of them, by grid cells (q06 has the boxes of a tenth)."""
    points = _xy(spark, sf_dir)
    point = points.select("id", F.col("x").alias("w"), F.col("y").alias("s"), F.col("x").alias("e"), F.col("y").alias("n"))
    box = points.select("id", (F.col("x") - 1).alias("w"), (F.col("y") - 1).alias("s"), (F.col("x") + 1).alias("e"), (F.col("y") + 1).alias("n"))
    return spatial.boxes_join(point, box, 5.0)
