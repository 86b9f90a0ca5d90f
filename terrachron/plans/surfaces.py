"""Queries over label anchors, pixel runs and filled rasters, each with its SQL twin."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.operators import anchors, masks
from terrachron.plans.queries import query
from terrachron.plans.territories import _RECTS, _ring, rectangle
from terrachron.sources import hydro
from terrachron.sources.shared import dealt
from terrachron.sources.tables import table


@query(f"""
WITH r AS ({_RECTS})
SELECT k AS id, round(x + w / 2, 5) AS x, round(y + h / 2, 5) AS y, round(least(w, h) / 2, 5) AS distance FROM r""")
def q152_label_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of each rectangle that is furthest from its border."""
    k, size = F.col("p_partkey"), F.col("p_size")
    ring = rectangle(k % 40, F.floor(k / 40), 0.4 + size / 50, 0.4 + size % 8 / 10)
    # A table of some large row groups is read by as few tasks.
    found = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), anchors.label_anchor(F.array(ring)).alias("a"))
    return found.select("id", *(F.round(f"a.{c}", 5).alias(c) for c in ("x", "y", "distance")))


@query("""
WITH t AS (SELECT vec_id AS id, list_transform(range(1, 7), lambda i: 12 + round(CAST(embedding[i] AS DOUBLE) * 30, 3)) AS o FROM embeddings),
e AS (SELECT id, i, o[2 * i + 1] AS x1, o[2 * i + 2] AS y1, o[2 * ((i + 1) % 3) + 1] AS x2, o[2 * ((i + 1) % 3) + 2] AS y2 FROM t, (SELECT unnest(range(0, 3)) AS i)),
b AS (SELECT id, floor(min(x1)) AS w, ceil(max(x1)) AS e, floor(min(y1)) AS s, ceil(max(y1)) AS n FROM e GROUP BY id),
p AS (SELECT id, unnest(range(CAST(w AS BIGINT), CAST(e AS BIGINT))) AS x, s, n FROM b), q AS (SELECT id, x, unnest(range(CAST(s AS BIGINT), CAST(n AS BIGINT))) AS y FROM p),
c AS (SELECT q.id, q.x, q.y, count(*) FILTER (WHERE (y1 <= q.y + 0.5) <> (y2 <= q.y + 0.5) AND q.x + 0.5 < x1 + (q.y + 0.5 - y1) * (x2 - x1) / (y2 - y1)) AS k FROM q JOIN e USING (id) GROUP BY ALL)
SELECT id, y, min(x) AS x1, max(x) AS x2 FROM c WHERE k % 2 = 1 GROUP BY id, y""")
def q153_pixel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of irregular triangles, row by row."""
    at = lambda i: 12 + F.round(F.col("embedding")[i].cast("double") * 30, 3)
    rings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _ring(*((at(2 * i), at(2 * i + 1)) for i in range(3))).alias("ring"))
    return masks.pixel_runs(rings)


@query("""
WITH g AS (SELECT CAST(p_partkey % 20 AS BIGINT) AS x, CAST(p_partkey // 20 AS BIGINT) AS y, CASE WHEN p_size <= 12 THEN p_retailprice END AS value FROM part),
n AS (SELECT a.x, a.y, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.y, b.x)) AS best FROM g a JOIN g b ON b.value IS NOT NULL GROUP BY a.x, a.y)
SELECT n.x, n.y, g.value, best[3] AS sx, best[2] AS sy FROM n JOIN g ON g.x = best[3] AND g.y = best[2]""")
def q154_nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of all parts whose unknown pixels take the nearest known value."""
    k = F.col("p_partkey")
    pixels = table(spark, sf_dir, "part").select((k % 20).alias("x"), F.floor(k / 20).alias("y"), F.when(F.col("p_size") <= 12, F.col("p_retailprice")).alias("value"))
    return masks.filled(pixels)


def _encoded(rows: pa.Table) -> pa.Table:
    """Fifty customers as a pack: a line of three corners each, with widths."""
    keys = rows.column("c_custkey").to_pylist()
    made = []
    for k, balance, nation in zip(keys, rows.column("c_acctbal").to_pylist(), rows.column("c_nationkey").to_pylist(), strict=True):
        x, y = round(balance * 100), k * 10
        head = {"fid": k, "logical_fid": k // 2, "kind": 1, "stage": nation % 4, "geometry_kind": 1, "flags": 0, "fragment_index": k % 2, "fragment_count": 2, "stroke_width": 1.0, "w": x, "s": y, "e": x + 300, "n": y + 7}
        made.append(head | {"stage": 1, "flags": nation, "lines": [(0, [(x, y), (x + 100, y + 7), (x + 300, y)], [k, k + 5, k % 3])]})
    return pa.table({"pack": pa.array([keys[0] // 50], pa.int64()), "content": pa.array([hydro.encode(made, 1)], pa.binary())})


@query("""
SELECT c_custkey // 50 AS pack, c_custkey AS fid, c_custkey // 2 AS logical_fid, CAST(c_nationkey AS INTEGER) AS flags, round(round(c_acctbal * 100) / 1e6, 6) AS first_x, round((round(c_acctbal * 100) + 300) / 1e6, 6) AS last_x, round((c_custkey * 10 + 7) / 1e6, 6) AS top, round((2 * c_custkey + 5 + c_custkey % 3) / 1000, 3) AS width FROM customer""")
def q155_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of lines written and decoded again, a batch at a time."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    packs = rows.groupBy(F.floor(F.col("c_custkey") / 50).alias("_pack")).applyInArrow(_encoded, "pack long, content binary")
    line = F.col("lines")[0]
    found = hydro.features(packs).select("pack", "fid", "logical_fid", "flags", line["points"].alias("p"), line["widths"].alias("w"))
    return found.select("pack", "fid", "logical_fid", "flags", F.round(F.col("p")[0]["x"], 6).alias("first_x"), F.round(F.col("p")[2]["x"], 6).alias("last_x"), F.round(F.col("p")[1]["y"], 6).alias("top"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 3).alias("width"))
