"""Queries over overlays, borders, faces and edits of territories, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrachron.functions.numeric import EARTH_RADIUS_KM
from terrachron.operators import linear, lod, overlay, seam, territories
from terrachron.plans.queries import query
from terrachron.sources.shared import dealt, settled
from terrachron.sources.tables import table


def _ring(*corners: tuple) -> Column:
    points = [F.struct(F.round(x, 6).cast("double").alias("x"), F.round(y, 6).cast("double").alias("y")) for x, y in corners]
    return F.array(*points, points[0])


def rectangle(x: Column, y: Column, w, h) -> Column:
    return _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _shapes(rows: DataFrame, key: str, ring: Column) -> DataFrame:
    # A table of few row groups is read by few tasks.
    return dealt(rows, key).select(F.col(key).alias("id"), F.lit(False).alias("hole"), ring.alias("ring"))


_RECTS = "SELECT p_partkey AS k, p_partkey % 40 AS x, p_partkey // 40 AS y, 0.4 + p_size / 50 AS w, 0.4 + p_size % 8 / 10 AS h FROM part"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each part, as wide and high as its size says, on a grid of 40 columns."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return _shapes(table(spark, sf_dir, "part"), "p_partkey", rectangle(k % 40, F.floor(k / 40), 0.4 + size / 50, 0.4 + size % 8 / 10))


@query(f"""
WITH r AS ({_RECTS}), p AS (SELECT a.k AS a, b.k AS b, a.w * a.h AS ta, b.w * b.h AS tb, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
FROM r a JOIN r b ON a.k < b.k AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)
SELECT a, b, round(i, 5) AS shared, round(ta + tb - i, 5) AS either, round(ta - i, 5) AS only_a, round(ta + tb - 2 * i, 5) AS one FROM p""")
def q140_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference, intersection and xor of all pairs of rectangles that meet."""
    shapes = _rects(spark, sf_dir)
    pairs = settled(territories.meeting(shapes, shapes, 1.0).where("a < b"))
    found = territories.pair_areas(pairs, shapes, shapes, ["intersection", "union", "difference", "xor"])
    return found.select("a", "b", *(F.round(c, 5).alias(n) for c, n in (("intersection", "shared"), ("union", "either"), ("difference", "only_a"), ("xor", "one"))))


@query("""
WITH t AS (SELECT vec_id AS k, vec_id % 30 AS cx, vec_id // 30 AS cy, list_transform(range(1, 7), lambda i: round(CAST(embedding[i] AS DOUBLE) * 2, 3)) AS o FROM embeddings),
c AS (SELECT k, cx, cy, CASE WHEN (o[3] - o[1]) * (o[6] - o[2]) - (o[4] - o[2]) * (o[5] - o[1]) < 0 THEN [o[1], o[2], o[5], o[6], o[3], o[4]] ELSE o END AS o FROM t),
e AS (SELECT k, cx, cy, i, o[2 * i + 1] AS px, o[2 * i + 2] AS py, o[2 * ((i + 1) % 3) + 1] AS qx, o[2 * ((i + 1) % 3) + 2] AS qy FROM c, (SELECT unnest(range(0, 3)) AS i)),
b AS (SELECT k, cx, cy, min(px) AS w, max(px) AS e, min(py) AS s, max(py) AS n, sum(px * qy - py * qx) / 2 AS area FROM e GROUP BY ALL),
p AS (SELECT a.k AS a, b.k AS b, a.area AS ta, b.area AS tb FROM b a JOIN b ON a.k < b.k AND a.cx + a.w < b.cx + b.e AND b.cx + b.w < a.cx + a.e AND a.cy + a.s < b.cy + b.n AND b.cy + b.s < a.cy + a.n),
x AS (SELECT a, b, f.k, f.i, f.px + f.cx - h.cx AS px, f.py + f.cy - h.cy AS py, f.qx + f.cx - h.cx AS qx, f.qy + f.cy - h.cy AS qy FROM p JOIN e f ON f.k IN (a, b) JOIN b h ON h.k = a),
y AS (SELECT x.*, (s.qx - s.px) * (x.py - s.py) - (s.qy - s.py) * (x.px - s.px) AS f0, (s.qx - s.px) * (x.qy - s.py) - (s.qy - s.py) * (x.qx - s.px) AS f1 FROM x JOIN x s ON s.a = x.a AND s.b = x.b AND s.k <> x.k),
z AS (SELECT a, b, k, i, any_value(px) AS px, any_value(py) AS py, any_value(qx) AS qx, any_value(qy) AS qy, max(CASE WHEN f0 < 0 AND f1 < 0 THEN 2 WHEN f0 < 0 THEN f0 / (f0 - f1) ELSE 0 END) AS t0, min(CASE WHEN f0 >= 0 AND f1 < 0 THEN f0 / (f0 - f1) ELSE 1 END) AS t1 FROM y GROUP BY a, b, k, i),
s AS (SELECT a, b, sum(CASE WHEN t1 > t0 THEN (px + t0 * (qx - px)) * (py + t1 * (qy - py)) - (py + t0 * (qy - py)) * (px + t1 * (qx - px)) ELSE 0 END) / 2 AS i FROM z GROUP BY a, b)
SELECT a, b, abs(round(i, 2)) AS shared, round(ta + tb - i, 2) AS either, round(ta - i, 2) AS only_a FROM s JOIN p USING (a, b)""")
def q141_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of all pairs of irregular triangles that meet, on a grid of a hundred-millionth (U3); the SQL clips edges by half planes."""
    k = F.col("vec_id")
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 2, 3)
    ring = lambda x, y: _ring(*((x + at(2 * i), y + at(2 * i + 1)) for i in range(3)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (k % 30).alias("x"), F.floor(k / 30).alias("y"))
    # Boxes that only touch may share a last digit: their sides are the sums that the SQL compares, not rounded to a grid.
    side = lambda of, c, first: F.col(c) + of(*(at(i) for i in range(first, 6, 2)))
    boxes = rows.select(k.alias("id"), *(side(of, c, first).alias(n) for n, of, c, first in (("w", F.least, "x", 0), ("s", F.least, "y", 1), ("e", F.greatest, "x", 0), ("n", F.greatest, "y", 1))))
    pairs = settled(territories.meeting_boxes(boxes, boxes, 1.0).where("a < b"))
    # Each pair in coordinates from its first triangle's place: then a finer grid fits.
    own = rows.select(F.col("vec_id").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    placed = pairs.join(own, "a")
    sides = [placed.join(rows.withColumnRenamed("vec_id", s), s).select(F.struct("a", "b").alias("gid"), F.lit(s).alias("side"), F.lit(False).alias("hole"), ring(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")).alias("ring")) for s in "ab"]
    pieces = overlay.overlay(sides[0].unionByName(sides[1]), ["intersection", "union", "difference"], 10**8)
    of = overlay.areas(pieces, ["gid", "rule"], 10**8).groupBy("gid").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("rule") == r, F.col("area"))), F.lit(0.0)), 2).alias(n) for r, n in (("intersection", "shared"), ("union", "either"), ("difference", "only_a"))))
    return of.select("gid.a", "gid.b", "shared", "either", "only_a")


@query("""
WITH k AS (SELECT c_custkey AS id, i AS component, c_custkey % 50 AS x, c_custkey // 50 * 4 + 2 * i AS y, 1 + c_custkey % 7 / 4 AS w, 1.5 AS h FROM customer, (SELECT unnest([0, 1]) AS i)),
c AS (SELECT s_suppkey % 25 * 2 + 0.25 AS x, s_suppkey // 25 * 3 + 0.5 AS y FROM supplier),
o AS (SELECT id, component, sum(greatest(0, least(k.x + w, c.x + 1) - greatest(k.x, c.x)) * greatest(0, least(k.y + h, c.y + 1) - greatest(k.y, c.y))) AS gone FROM k, c WHERE k.x < c.x + 1 AND c.x < k.x + w AND k.y < c.y + 1 AND c.y < k.y + h GROUP BY ALL)
SELECT id, component, round(w * h - coalesce(gone, 0), 5) AS area FROM k LEFT JOIN o USING (id, component)""")
def q142_component_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cutters leave of each component of each territory (U4, P25)."""
    k, i = F.col("c_custkey"), F.col("component")
    rows = dealt(table(spark, sf_dir, "customer"), "c_custkey").withColumn("component", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = rows.select(k.alias("id"), "component", F.lit(False).alias("hole"), rectangle(k % 50, F.floor(k / 50) * 4 + 2 * i, 1 + k % 7 / 4, 1.5).alias("ring"))
    s = F.col("s_suppkey")
    cutters = _shapes(table(spark, sf_dir, "supplier"), "s_suppkey", rectangle(s % 25 * 2 + 0.25, F.floor(s / 25) * 3 + 0.5, 1.0, 1.0))
    found = territories.component_difference(parts, cutters, 1.0)
    return found.groupBy("id", "component").agg(F.round(F.sum("area"), 5).alias("area"))


@query("""
WITH r AS (SELECT c_custkey AS k, -1 - c_custkey % 3 AS parent, c_custkey // 60 AS strip, round(c_acctbal / 50, 2) AS lo, round(c_acctbal / 50, 2) + 2 + c_custkey % 5 AS hi, c_custkey % 4 = 0 AS snapshot FROM customer),
p AS (SELECT a.k, b.k AS peer, greatest(a.lo, b.lo) AS l, least(a.hi, b.hi) AS h FROM r a JOIN r b ON a.k <> b.k AND a.parent = b.parent AND a.strip = b.strip AND a.lo < b.hi AND b.lo < a.hi AND NOT (a.snapshot AND b.snapshot)),
m AS (SELECT *, coalesce(max(h) OVER (PARTITION BY k ORDER BY l, h, peer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS until FROM p),
c AS (SELECT k, sum(greatest(0, h - greatest(l, until))) AS gone, list(CAST(peer AS VARCHAR) ORDER BY CAST(peer AS VARCHAR)) AS related FROM m GROUP BY k)
SELECT r.k AS id, CASE WHEN c.k IS NULL THEN 'unchanged' WHEN round(hi - lo - gone, 4) > 0 THEN 'unknown-peer-overlap' ELSE 'empty-after-adjustment' END AS kind, round(abs(hi - lo - coalesce(gone, 0)), 4) AS area, coalesce(array_to_string(related, ','), '') AS related FROM r LEFT JOIN c USING (k)""")
def q143_rival_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of rivals are nobody's (U6, J9): strips of height 1 that overlap lengthwise."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    shapes = _shapes(customers, "c_custkey", rectangle(F.round(F.col("c_acctbal") / 50, 2), F.floor(k / 60) * 2, 2 + k % 5, 1.0))
    rows = customers.select(k.alias("id"), (-1 - k % 3).alias("parent"), (k % 4 == 0).alias("snapshot"))
    after, log = territories.adjusted(rows, shapes, 4.0)
    found = rows.select("id").join(territories.shape_areas(after), "id", "left").join(log, "id", "left")
    return found.select("id", F.coalesce("kind", F.lit("unchanged")).alias("kind"), F.round(F.coalesce("area", F.lit(0.0)), 4).alias("area"), F.coalesce(F.array_join("related", ","), F.lit("")).alias("related"))


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS owner, CAST(floor(c_acctbal / 300) AS BIGINT) AS x, c_custkey % 37 AS y FROM customer),
n AS (SELECT owner, sum(4 - (SELECT count(*) FROM c b WHERE b.owner = c.owner AND abs(b.x - c.x) + abs(b.y - c.y) = 1)) AS around, count(*) AS area FROM c GROUP BY owner)
SELECT owner, CAST(area AS DOUBLE) AS area, CAST(around AS DOUBLE) AS around FROM n""")
def q144_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each nation's cells, its area and the length of all its rings."""
    rows = table(spark, sf_dir, "customer")
    shapes = _shapes(rows, "c_custkey", rectangle(F.floor(F.col("c_acctbal") / 300), F.col("c_custkey") % 37, 1, 1))
    found = territories.merged(shapes, rows.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner")))
    around = F.aggregate(F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.hypot(F.get(r, i)["x"] - F.get(r, i - 1)["x"], F.get(r, i)["y"] - F.get(r, i - 1)["y"])))), F.lit(0.0), lambda a, x: a + x)
    return found.groupBy("owner").agg(F.sum("area").alias("area"), F.sum(around).alias("around"))


_BRICKS = "SELECT p_partkey AS k, p_partkey // 40 AS row, p_partkey % 40 + (p_partkey // 40 * 37) % 10 / 10 AS x FROM part"


def _bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brick for each part, rows of 40 that are shifted against each other."""
    k = F.col("p_partkey")
    row = F.floor(k / 40)
    return _shapes(table(spark, sf_dir, "part"), "p_partkey", rectangle(k % 40 + (row * 37) % 10 / 10, row, 1, 1))


@query(f"""
WITH r AS ({_BRICKS})
SELECT a.k AS a, b.k AS b, CAST(1 AS INTEGER) AS line_no, CASE WHEN a.row = b.row THEN 1.0 ELSE round(CAST(1 - abs(a.x - b.x) AS DOUBLE), 4) END AS length FROM r a JOIN r b ON a.k < b.k AND ((a.row = b.row AND b.k = a.k + 1) OR (b.row = a.row + 1 AND abs(a.x - b.x) < 1))""")
def q145_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common borders of all pairs of bricks, where edges coincide in part."""
    shapes = _bricks(spark, sf_dir)
    near = shapes.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] * 1.0001).alias("x"), (p["y"] * 1.0).alias("y"))))
    wide = near.withColumn("ring", rectangle(F.col("ring")[0]["x"] - 0.01, F.col("ring")[0]["y"] - 0.01, 1.02, 1.02))
    pairs = settled(territories.meeting(wide, wide, 1.0).where("a < b"))
    return territories.pair_borders(pairs, shapes).select("a", "b", "line_no", F.round("length", 4).alias("length"))


@query("""
WITH x AS (SELECT DISTINCT c_nationkey AS gid, CAST(round(c_acctbal / 10) AS BIGINT) AS x FROM customer), g AS (SELECT gid, x - lag(x) OVER (PARTITION BY gid ORDER BY x) AS gap FROM x)
SELECT gid, CAST(gap AS DOUBLE) AS area, count(*) AS n FROM g, (SELECT unnest(range(0, 4)) AS y) WHERE gap IS NOT NULL GROUP BY gid, gap""")
def q146_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces between each nation's upright lines and five level ones."""
    line = lambda x1, y1, x2, y2: [c.cast("long").alias(n) for c, n in zip((x1, y1, x2, y2), overlay.ENDS, strict=True)] + [F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")]
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gid"), F.round(F.col("c_acctbal") / 10).alias("x")).distinct()
    upright = x.select("gid", *line(F.col("x"), F.lit(0), F.col("x"), F.lit(4)))
    level = x.groupBy("gid").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4))))
    pieces = overlay.arranged(upright.unionByName(level.select("gid", *line(F.col("lo"), F.col("y"), F.col("hi"), F.col("y")))), 4)
    return overlay.faces(pieces, 1).where("area > 0").groupBy("gid", "area").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT DISTINCT o_orderkey // 1000 AS gid, o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 3),
r AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY gid ORDER BY k)), i AS (SELECT *, sum(new) OVER (PARTITION BY gid ORDER BY k) AS no FROM r)
SELECT gid, CAST(min(k) AS DOUBLE) AS x, count(*) AS n, CAST(count(*) AS DOUBLE) AS length FROM i GROUP BY gid, no""")
def q147_boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges walked into lines."""
    k = F.col("o_orderkey")
    edges = table(spark, sf_dir, "orders").where(k % 7 != 3).select(F.floor(k / 1000).alias("gid"), k.alias("x1"), F.lit(0).cast("long").alias("y1"), (k + 1).alias("x2"), F.lit(0).cast("long").alias("y2"))
    return overlay.chains(edges, 1).select("gid", F.col("points")[0]["x"].alias("x"), "n", "length")


@query(f"""
WITH r AS ({_BRICKS}), t AS (SELECT k, row, x, k % 40 < 39 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = k + 1) AS allowed FROM r WHERE k % 10 = 0)
SELECT r.k AS id, CASE WHEN g.allowed THEN 1.5 WHEN l.allowed THEN 0.5 ELSE 1.0 END AS area, coalesce(NOT g.allowed, false) AS refused FROM r LEFT JOIN t g ON g.k = r.k LEFT JOIN t l ON l.k = r.k - 1""")
def q148_annexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth brick takes half of the next one; where there is none, nothing moves."""
    shapes = _bricks(spark, sf_dir)
    first = F.col("ring")[0]
    areas = shapes.where(F.col("id") % 10 == 0).select(F.col("id").alias("target"), "hole", rectangle(first["x"] + 1, first["y"], 0.5, 1).alias("ring"))
    after, refused = territories.annexed(shapes, areas, 1.0)
    found = shapes.select("id").join(territories.shape_areas(after), "id", "left").join(refused.select("id", F.lit(True).alias("r")), "id", "left")
    return found.select("id", F.round(F.coalesce("area", F.lit(0.0)), 4).alias("area"), F.coalesce("r", F.lit(False)).alias("refused"))


@query("""
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN p_size / 1000 ELSE 0 END AS bent FROM part)
SELECT a.k AS owner, CAST(4 + CASE WHEN a.bent > 0 THEN 1 ELSE 0 END + CASE WHEN l.bent > 0 THEN 1 ELSE 0 END AS BIGINT) AS n, round(1 + a.bent / 2 - coalesce(l.bent, 0) / 2, 6) AS area FROM p a LEFT JOIN p l ON l.k = a.k - 1 AND a.k % 40 > 0""")
def q149_simplified_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh of squares whose upright borders are bent in the middle: each border is simplified once for both its owners."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    x, y = k % 40, F.floor(k / 40)
    before = part.select((k + 1).alias("p_partkey"), F.col("p_size").alias("left_size"))
    rows = part.join(before, "p_partkey", "left").withColumn("left_size", F.when(x > 0, F.col("left_size")))
    left = F.when(F.col("left_size").isNotNull(), F.col("left_size") / 1000).otherwise(0.0)
    ring = _ring((x, y), (x + 1, y), (x + 1 + F.col("p_size") / 1000, y + 0.5), (x + 1, y + 1), (x, y + 1), (x + left, y + 0.5))
    rings = rows.select(F.lit(1).alias("gid"), k.alias("owner"), F.lit(False).alias("hole"), ring.alias("ring"))
    return lod.simplified_map(rings, 0.0305).select("owner", "n", F.round("area", 6).alias("area"))


@query("""
WITH a AS (SELECT c_custkey AS k, c_custkey // 60 * 10 + c_custkey % 60 / 25 AS y, c_custkey * 7 % 100 AS x1, c_custkey * 7 % 100 + 5 + c_custkey % 5 AS x2 FROM customer),
b AS (SELECT s_suppkey AS k, s_suppkey // 4 * 10 AS y, s_suppkey % 4 * 25 AS x1, s_suppkey % 4 * 25 + 20 AS x2 FROM supplier),
r AS (SELECT a.k AS a, b.k AS b, greatest(a.x1, b.x1) AS lo, least(a.x2, b.x2) AS hi, a.x1 AS x, b.x2 AS z FROM a JOIN b ON abs(a.y - b.y) <= 1)
SELECT a, b, CAST(1 AS INTEGER) AS run_no, CAST(lo - x AS DOUBLE) AS from_a, CAST(hi - x AS DOUBLE) AS to_a, CAST(z - lo AS DOUBLE) AS from_b, CAST(z - hi AS DOUBLE) AS to_b FROM r WHERE hi - lo >= 1""")
def q150_border_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines run along borders, as measures on both; borders run westwards."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    y = F.floor(k / 60) * 10 + k % 60 / 25
    lines = table(spark, sf_dir, "customer").select(k.alias("id"), F.array(at(k * 7 % 100, y), at(k * 7 % 100 + 2, y), at(k * 7 % 100 + 5 + k % 5, y)).alias("points"))
    borders = table(spark, sf_dir, "supplier").select(s.alias("id"), F.array(*(at(s % 4 * 25 + d, F.floor(s / 4) * 10) for d in (20, 9, 0))).alias("points"))
    found = linear.runs_along(lines, borders, 1.0, 1.0)
    return found.select("a", "b", "run_no", *(F.round(c, 6).alias(c) for c in ("from_a", "to_a", "from_b", "to_b")))


_OVER_SEAM = "SELECT p_partkey AS id, 170 + p_partkey % 20 AS w, 5 + p_size / 4 AS wide, p_partkey // 20 % 14 * 10 - 70 AS s, 3 + p_size % 6 AS high FROM part"


@query(f"""
WITH r AS ({_OVER_SEAM})
SELECT id, round(wide * high, 4) AS area, CASE WHEN w < 180 AND w + wide > 180 THEN 2 ELSE 1 END AS polygons, round(radians(wide) * (sin(radians(s + high)) - sin(radians(s))) * {EARTH_RADIUS_KM} * {EARTH_RADIUS_KM}, 3) AS km2 FROM r""")
def q151_over_the_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles over the antimeridian: cut in two, with their areas in square degrees and on the sphere."""
    k, size = F.col("p_partkey"), F.col("p_size")
    east = lambda x: F.when(x >= 180, x - 360).otherwise(x)
    w, s, wide, high = 170 + k % 20, F.floor(k / 20) % 14 * 10 - 70, 5 + size / 4, 3 + size % 6
    ring = _ring((east(w), s), (east(w + wide), s), (east(w + wide), s + high), (east(w), s + high))
    rows = _shapes(table(spark, sf_dir, "part"), "p_partkey", ring)
    found = seam.cut_at_seam(rows).groupBy("id").agg(F.round(F.sum("area"), 4).alias("area"), F.count("*").cast("int").alias("polygons"))
    return found.join(rows.select("id", F.round(seam.spherical_area_km2(F.col("ring")), 3).alias("km2")), "id")
