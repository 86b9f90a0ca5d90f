"""The operators applied to the supplied tables: one function for each registered query, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terrachron.functions import geometry, numeric, temporal, text
from terrachron.operators import changes, hierarchy, intervals, places, quality, ranges, ranking, rivers, spatial, timeline
from terrachron.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS since
FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-30')""")
def q01_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order as of a day."""
    orders = intervals.versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    now = intervals.as_of(orders, F.lit("1998-06-30").cast("timestamp_ntz"), "o_orderdate")
    return now.select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("since"))


@query("""
WITH e AS (SELECT *, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events),
f AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 1800 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS first_s, max(s) AS last_s, count(*) AS n_rows FROM g GROUP BY ALL""")
def q02_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of half an hour at most."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("first_s")).withColumn("last_s", F.col("first_s"))
    return intervals.coalesced(events, ["user_id"], "first_s", "last_s", F.col("first_s") - F.col("_reach") <= 1800, ["event_id"])


@query("""
WITH o AS (SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL 60 DAY AS hi, o_orderpriority AS p FROM orders),
c AS (SELECT DISTINCT o_custkey, unnest([lo, hi]) AS lo FROM o),
e AS (SELECT * FROM (SELECT *, lead(lo) OVER (PARTITION BY o_custkey ORDER BY lo) AS hi FROM c) WHERE hi IS NOT NULL),
s AS (SELECT e.o_custkey, e.lo, e.hi, count(o.p) AS old_n, count(*) FILTER (WHERE o.p = '1-URGENT') AS new_n FROM e LEFT JOIN o ON e.o_custkey = o.o_custkey AND o.lo <= e.lo AND o.hi >= e.hi GROUP BY ALL),
d AS (SELECT *, old_n <> new_n AS differs FROM s),
r AS (SELECT *, sum(CASE WHEN differs IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(differs) OVER (PARTITION BY o_custkey ORDER BY lo) AS prev FROM d))
SELECT o_custkey, strftime(min(lo), '%Y-%m-%d') AS lo, strftime(max(hi), '%Y-%m-%d') AS hi FROM r WHERE differs GROUP BY o_custkey, run""")
def q03_change_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in which a customer's open orders differ between two revisions (all orders, urgent ones), runs merged."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("hi"), F.col("o_orderpriority").alias("p"))
    pieces = intervals.elementary(orders, ["o_custkey"], [F.col("lo"), F.col("hi")])
    o = orders.select(F.col("o_custkey").alias("k"), F.col("lo").alias("a"), F.col("hi").alias("b"), "p")
    held = pieces.join(o, (F.col("o_custkey") == F.col("k")) & (F.col("a") <= F.col("lo")) & (F.col("b") >= F.col("hi")), "left")
    state = held.groupBy("o_custkey", "lo", "hi").agg((F.count("p") != F.count(F.when(F.col("p") == "1-URGENT", 1))).alias("differs"))
    w = Window.partitionBy("o_custkey").orderBy("lo")
    runs = state.withColumn("new", (~F.col("differs").eqNullSafe(F.lag("differs").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    out = runs.where("differs").groupBy("o_custkey", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("o_custkey", F.date_format("lo", "yyyy-MM-dd").alias("lo"), F.date_format("hi", "yyyy-MM-dd").alias("hi"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 120 DAY AS hi FROM orders),
p AS (SELECT o_custkey, greatest(lo, TIMESTAMP '1997-01-01') AS lo, least(hi, TIMESTAMP '1998-01-01') AS hi, o_orderkey FROM o WHERE lo < TIMESTAMP '1998-01-01' AND hi > TIMESTAMP '1997-01-01'),
r AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT o_custkey, bool_and(lo <= coalesce(reach, TIMESTAMP '1997-01-01')) AND max(hi) = TIMESTAMP '1998-01-01' AS covered FROM r GROUP BY o_custkey""")
def q04_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's orders, each good for 120 days, cover the whole of 1997."""
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1998-01-01"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 120 days")).alias("hi"))
    inside = orders.where((F.col("lo") < end) & (F.col("hi") > start)).withColumns({"lo": F.greatest("lo", start), "hi": F.least("hi", end)})
    w = Window.partitionBy("o_custkey").orderBy("lo", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("reach", F.coalesce(F.max("hi").over(w), start)).groupBy("o_custkey").agg((F.bool_and(F.col("lo") <= F.col("reach")) & (F.max("hi") == end)).alias("covered"))


@query("""
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t AS (SELECT id, p, id AS root, 0 AS depth FROM n WHERE p IS NULL UNION ALL SELECT n.id, n.p, t.root, t.depth + 1 FROM n JOIN t ON n.p = t.id)
SELECT id, root AS root_id, CAST(depth AS INTEGER) AS depth, 'Valid' AS state FROM t""")
def q05_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of regions, nations and customers."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nodes = nodes.union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    nodes = nodes.union(table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey")))
    return hierarchy.ancestors(nodes).select("id", "root_id", F.size("ancestors").alias("depth"), "state")


_POINTS = "SELECT vec_id AS id, round(embedding[1] * 300, 3) AS lon, round(embedding[2] * 150, 3) AS lat FROM embeddings"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * 300, 3).alias("lon"), F.round(e[1].cast("double") * 150, 3).alias("lat"))


@query(f"""
WITH p AS ({_POINTS.replace("embedding[1]", "CAST(embedding[1] AS DOUBLE)").replace("embedding[2]", "CAST(embedding[2] AS DOUBLE)")}),
b AS (SELECT id, lon - 1 AS w, lat - 1 AS s, lon + 1 AS e, lat + 1 AS n FROM p WHERE id % 10 = 0)
SELECT p.id AS a_id, b.id AS b_id FROM p JOIN b ON p.lon BETWEEN b.w AND b.e AND p.lat BETWEEN b.s AND b.n""")
def q06_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the boxes around a stated tenth of them, by grid cells."""
    points = _points(spark, sf_dir)
    point = points.select("id", F.col("lon").alias("w"), F.col("lat").alias("s"), F.col("lon").alias("e"), F.col("lat").alias("n"))
    box = points.where("id % 10 = 0").select("id", (F.col("lon") - 1).alias("w"), (F.col("lat") - 1).alias("s"), (F.col("lon") + 1).alias("e"), (F.col("lat") + 1).alias("n"))
    return spatial.boxes_join(point, box, 5.0)


@query(f"""
WITH p AS ({_POINTS.replace("embedding[1]", "CAST(embedding[1] AS DOUBLE)").replace("embedding[2]", "CAST(embedding[2] AS DOUBLE)")}),
d AS (SELECT a.id, b.id AS other, 12742.016 * asin(least(1.0, sqrt(greatest(0.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) AS km FROM p a JOIN p b ON a.id <> b.id AND abs(a.lat - b.lat) < 2)
SELECT p.id, round(coalesce(sum(exp(-km / 65)), 0), 6) AS crowding, count(km) AS n FROM p LEFT JOIN (SELECT * FROM d WHERE km <= 200) d ON p.id = d.id GROUP BY p.id""")
def q07_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How crowded each point is by others within 200 km, all of one weight."""
    found = spatial.crowding(_points(spark, sf_dir).withColumn("weight", F.lit(1.0)), "weight")
    return found.select("id", F.round("crowding", 6).alias("crowding"), "n")


@query("""
SELECT reason, bucket, count(*) AS n, count(*) FILTER (WHERE c_acctbal >= 5000) AS n_auto FROM (
SELECT c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'capital' WHEN c_mktsegment = 'MACHINERY' THEN 'admin-seat-1' WHEN c_acctbal >= 2500 THEN 'population-50k' END AS reason,
CASE WHEN c_acctbal >= 7500 THEN '1m-plus' WHEN c_acctbal >= 5000 THEN '100k-999k' WHEN c_acctbal >= 2500 THEN '50k-99k' ELSE 'under-50k-admin' END AS bucket FROM customer)
WHERE reason IS NOT NULL GROUP BY reason, bucket""")
def q08_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion reasons and size buckets, counted in one pass."""
    b = F.col("c_acctbal")
    reason = F.when(F.col("c_mktsegment") == "BUILDING", "capital").when(F.col("c_mktsegment") == "MACHINERY", "admin-seat-1").when(b >= 2500, "population-50k")
    bucket = F.when(b >= 7500, "1m-plus").when(b >= 5000, "100k-999k").when(b >= 2500, "50k-99k").otherwise("under-50k-admin")
    rows = table(spark, sf_dir, "customer").select("c_acctbal", reason.alias("reason"), bucket.alias("bucket")).where("reason is not null")
    return rows.groupBy("reason", "bucket").agg(F.count("*").alias("n"), F.count_if(b >= 5000).alias("n_auto"))


@query("""
SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS r FROM part) WHERE r <= 5""")
def q09_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest parts of each brand."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return ranking.top_per_group(parts, ["p_brand"], 5, [F.desc("p_retailprice"), F.desc("p_size"), F.asc("p_partkey")]).drop("p_size")


@query("""
SELECT p_partkey, p_name, starts_with(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), 'red w') AS by_prefix, contains(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), 'bolt') AS by_part FROM part
WHERE starts_with(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), 'red w') OR contains(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), 'bolt')""")
def q10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and substring search over normalised names."""
    name = F.col("p_name")
    found = table(spark, sf_dir, "part").select("p_partkey", "p_name", text.starts(name, " RED  W").alias("by_prefix"), text.finds(name, "bolt").alias("by_part"))
    return found.where("by_prefix or by_part")


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, quantile_disc(l_extendedprice, 0.95) AS p95_rank, count(*) AS n, max(l_extendedprice) AS most
FROM lineitem GROUP BY l_returnflag""")
def q11_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank quantiles."""
    rows = table(spark, sf_dir, "lineitem")
    found = ranges.quantiles(rows, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}, {"p95_rank": 0.95})
    return found.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("median", "p90", "p99")), "p95_rank", "n", "most")


@query("""
WITH r AS (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier WHERE isfinite(s_acctbal) GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN hi > lo THEN 0.12 + 0.58 * greatest(0, least(1, (s_acctbal - lo) / (hi - lo))) ELSE 0.7 END, 9) AS alpha FROM supplier JOIN r USING (s_nationkey)""")
def q12_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opacity of each value in its group's finite range."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    finite = F.when(~F.isnan("s_acctbal") & (F.abs("s_acctbal") < float("inf")), F.col("s_acctbal"))
    ranges = rows.groupBy("s_nationkey").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    return rows.join(ranges, "s_nationkey").select("s_suppkey", F.round(numeric.value_alpha(F.col("s_acctbal"), F.col("lo"), F.col("hi")), 9).alias("alpha"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2),
a AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (l_orderkey, l_linenumber) WHERE (b.q, b.n) IS DISTINCT FROM (a.q, a.n)""")
def q13_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two slices of lineitem, by key."""
    def slice_of(where: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").where(where)
        return rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))

    return changes.revision_diff(slice_of("l_shipdate < timestamp_ntz '1998-01-01'"), slice_of("l_shipdate >= timestamp_ntz '1996-01-01'"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT s_suppkey, s_name, s_nationkey, 'authored' AS origin FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'reference' FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def q14_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored rows replace reference rows of the same key."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    authored = rows.where("s_acctbal < 0").drop("s_acctbal").withColumn("origin", F.lit("authored"))
    return changes.overlay(authored, rows.drop("s_acctbal").withColumn("origin", F.lit("reference")), ["s_suppkey"])


@query("""
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 100""")
def q15_same_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one brand, type and size whose prices are near."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    a, b = p.alias("a"), p.alias("b")
    on = F.expr("a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey and abs(a.p_retailprice - b.p_retailprice) <= 100")
    return a.join(b, on).select(F.col("a.p_partkey").alias("a_key"), F.col("b.p_partkey").alias("b_key"))


@query("""
SELECT 'orphan-order' AS rule, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'duplicate-line', concat_ws('|', l_orderkey, l_linenumber), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'negative-balance', CAST(s_suppkey AS VARCHAR), CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) FROM supplier WHERE NOT s_acctbal >= 0""")
def q16_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans, duplicates and failing rows as one report."""
    solvent = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return quality.report(
        quality.orphans(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", solvent, "c_custkey", "orphan-order"),
        quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate-line"),
        quality.failing(table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_acctbal") >= 0, F.floor("s_acctbal"), "negative-balance"),
    )


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS p, p_size AS v FROM part),
t AS (SELECT id, id AS top, v FROM n UNION ALL SELECT t.id, n.p, t.v FROM t JOIN n ON t.top = n.id WHERE n.p IS NOT NULL)
SELECT top AS id, CAST(max(v) AS INTEGER) AS p_size FROM t WHERE top IN (SELECT id FROM n) GROUP BY top""")
def q17_propagate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest value below each node of a forest (parent: half the key)."""
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 1, F.floor(key / 2)).cast("long").alias("parent_id"), "p_size")
    return hierarchy.propagate_max(nodes, "p_size").join(nodes.select("id"), "id", "left_semi")


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'open' WHEN event_type = 'error' THEN 'closed' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'new') AS state FROM events""")
def q18_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's state after each event."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return changes.replay(events, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error").select("event_id", "state")


@query(f"""
WITH p AS ({_POINTS.replace("embedding[1]", "CAST(embedding[1] AS DOUBLE)").replace("embedding[2]", "CAST(embedding[2] AS DOUBLE)")}),
b AS (SELECT id, greatest(-180, lon - 3) AS w, greatest(-90, lat - 3) AS s, least(180, lon + 3) AS e, least(90, lat + 3) AS n FROM p WHERE abs(lon) < 180 AND abs(lat) < 90)
SELECT id, y.ty, x.tx FROM b, LATERAL (SELECT unnest(range(CAST(greatest(0, least(35, floor((90 - n) / 180 * 36))) AS BIGINT), CAST(greatest(0, least(35, floor((90 - s) / 180 * 36))) AS BIGINT) + 1)) AS ty) y, LATERAL (SELECT unnest(range(CAST(least(71, floor((w + 180) / 360 * 72)) AS BIGINT), CAST(least(71, floor((e + 180) / 360 * 72)) AS BIGINT) + 1)) AS tx) x""")
def q19_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that each box covers in a grid of 72 by 36."""
    clip = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), c))
    lon, lat = F.col("lon"), F.col("lat")
    boxes = _points(spark, sf_dir).where("abs(lon) < 180 and abs(lat) < 90").select("id", clip(lon - 3, 180.0).alias("w"), clip(lat - 3, 90.0).alias("s"), clip(lon + 3, 180.0).alias("e"), clip(lat + 3, 90.0).alias("n"))
    return spatial.tiles(boxes, F.lit(72), F.lit(36)).select("id", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query("""
SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS BIGINT) AS even, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS up, CAST(round_even(abs(p_retailprice) / 25, 0) * 25 AS BIGINT) AS step FROM part""")
def q20_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounding families."""
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", numeric.half_even(p).cast("long").alias("even"), numeric.half_up(p).cast("long").alias("up"), numeric.quantise(p, 25.0).cast("long").alias("step"))


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS v FROM e)
SELECT event_id, v[CAST(ceil(len(v) * 0.95) AS BIGINT)] AS p95 FROM w WHERE i % 20 = 0""")
def q21_rolling_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth event of a user: nearest-rank p95 of its last sixty values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value").withColumn("i", F.row_number().over(w))
    rows = rows.withColumn("v", F.array_sort(F.collect_list("value").over(w.rowsBetween(-59, 0)))).where("i % 20 = 0")
    return rows.select("event_id", F.element_at("v", F.ceil(F.size("v") * 0.95).cast("int")).alias("p95"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, CAST(i AS INTEGER) AS i, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM l""")
def q22_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running length along each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w)).select("l_orderkey", "i", F.col("l_quantity").cast("long").alias("q"))
    return ranking.profile(rows, ["l_orderkey"], ["i"], "q").drop("q")


@query("""
SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS rank, CASE WHEN c_acctbal >= 9000 THEN 1 WHEN c_acctbal >= 7000 THEN 2 WHEN c_acctbal >= 5000 THEN 3 WHEN c_acctbal >= 0 THEN 4 END AS stage
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r <= 8""")
def q23_best_and_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight of each parent with the stage that their score reaches."""
    best = ranking.top_per_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 8, [F.desc("c_acctbal"), F.desc("c_custkey")])
    return best.select("c_nationkey", "c_custkey", "rank", ranking.stage(F.col("c_acctbal"), [9000, 7000, 5000, 0]).alias("stage"))


@query("""
SELECT digest, n, first_id FROM (SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE n > 1""")
def q24_duplicate_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, by content hash."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())""")
def q25_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several group counts from one pass."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders),
r AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT o_custkey, strftime(reach, '%Y-%m-%d') AS gap_lo, strftime(lo, '%Y-%m-%d') AS gap_hi FROM r WHERE reach < lo""")
def q26_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a customer's orders of 30 days each."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    found = intervals.gaps(orders, ["o_custkey"], "lo", "hi", ["o_orderkey"])
    return found.select("o_custkey", F.date_format("gap_lo", "yyyy-MM-dd").alias("gap_lo"), F.date_format("gap_hi", "yyyy-MM-dd").alias("gap_hi"))


@query("""
SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, CASE WHEN count(DISTINCT l_suppkey) >= 3 THEN 'multi' WHEN count(DISTINCT l_suppkey) = 2 THEN 'shared' ELSE 'coast' END AS kind, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS owner_list FROM lineitem GROUP BY l_partkey""")
def q27_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many owners share an edge, and which."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    kind = F.when(F.col("owners") >= 3, "multi").when(F.col("owners") == 2, "shared").otherwise("coast")
    found = pairs.groupBy("l_partkey").agg(F.count("*").alias("owners"), F.array_sort(F.collect_list("l_suppkey")).alias("list"))
    return found.select("l_partkey", "owners", kind.alias("kind"), F.array_join(F.col("list").cast("array<string>"), ",").alias("owner_list"))


@query("""
WITH p AS (SELECT DISTINCT label, round(CAST(embedding[1] AS DOUBLE) * 300, 3) % 180 AS x FROM embeddings),
n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY label ORDER BY x), first_value(x) OVER (PARTITION BY label ORDER BY x) + 360) AS y FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(y - x, 6) DESC, x) AS i FROM n)
SELECT label, round(CASE WHEN y >= 180 THEN y - 360 ELSE y END, 3) AS west, round(x, 3) AS east FROM r WHERE i = 1""")
def q28_circle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest arc of longitudes of each label."""
    points = table(spark, sf_dir, "embeddings").select("label", (F.round(F.col("embedding")[0].cast("double") * 300, 3) % 180).alias("x"))
    found = ranking.bounds_on_circle(points, "label", "x")
    return found.select("label", F.round("west", 3).alias("west"), F.round("east", 3).alias("east"))


@query("""
WITH b AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'OURS' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0), t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'THEIRS' ELSE c_mktsegment END AS v FROM customer),
j AS (SELECT c_custkey, b.v AS b, o.v AS o, t.v AS t FROM b FULL JOIN o USING (c_custkey) FULL JOIN t USING (c_custkey))
SELECT c_custkey, CASE WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b OR o IS NOT DISTINCT FROM t THEN o END AS merged,
CASE WHEN o IS NOT DISTINCT FROM t THEN CASE WHEN o IS NOT DISTINCT FROM b THEN 'same' ELSE 'both' END WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN t IS NOT DISTINCT FROM b THEN 'ours' ELSE 'conflict' END AS outcome FROM j""")
def q29_three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of one base merged."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    ours = rows.where("c_custkey % 11 <> 0").withColumn("v", F.when(F.col("c_custkey") % 5 == 0, "OURS").otherwise(F.col("v")))
    theirs = rows.withColumn("v", F.when(F.col("c_custkey") % 3 == 0, "THEIRS").otherwise(F.col("v")))
    return changes.three_way(rows.where("c_custkey % 7 <> 0"), ours, theirs, "c_custkey", "v")


@query("""
SELECT o_orderkey, y * 10000 + m * 100 + 1 AS start, y * 10000 + m * 100 + day(last_day(make_date(y, m, 1))) AS end_key, strftime(make_date(y, m, 1) - INTERVAL 7 MONTH, '%Y-%m') AS shifted,
CAST(strftime(last_day(make_date(y, m, 1)) + INTERVAL 1 DAY, '%Y%m%d') AS BIGINT) AS following
FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)""")
def q30_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar months: bounds, a shift and the day after."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    p = temporal.parse(month)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["start"].alias("start"), p["end"].alias("end_key"), temporal.shift_month(month, -7).alias("shifted"), temporal.following_day(p["end"]).alias("following"))


@query(f"""
WITH p AS ({_POINTS.replace("embedding[1]", "CAST(embedding[1] AS DOUBLE)").replace("embedding[2]", "CAST(embedding[2] AS DOUBLE)")}),
e AS (SELECT vec_id, list_transform(embedding[3:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT id, lon, lat, round(2 + abs(e[1]) * 5, 3) AS a, round(1 + abs(e[2]) * 5, 3) AS b, round(e[3] * 15, 3) AS dx, round(e[4] * 8, 3) AS dy FROM p JOIN e ON id = vec_id)
SELECT id, round(4 * a * b, 6) AS area, round(lon, 3) AS mid_x, round(lat, 3) AS mid_y, CAST(CASE WHEN abs(dx) > a OR abs(dy) > b THEN 0 WHEN abs(dx) = a OR abs(dy) = b THEN 2 ELSE 1 END AS INTEGER) AS probe, CAST(CASE WHEN abs(dx) > a THEN 0 ELSE 2 END AS INTEGER) AS top FROM q""")
def q31_ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, mean and point tests of a box around each point, as large as its vector says."""
    part = lambda i: F.col("embedding")[i].cast("double")
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(2 + F.abs(part(2)) * 5, 3).alias("a"), F.round(1 + F.abs(part(3)) * 5, 3).alias("b"), F.round(part(4) * 15, 3).alias("dx"), F.round(part(5) * 8, 3).alias("dy"))
    lon, lat, a, b = (F.col(c) for c in ("lon", "lat", "a", "b"))
    corner = lambda x, y: F.struct((lon + x * a).alias("x"), (lat + y * b).alias("y"))
    rows = _points(spark, sf_dir).join(sizes, "id").withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))
    ring, mean = F.col("ring"), geometry.vertex_mean(F.col("ring"))
    at = lambda x, y: geometry.in_ring(lon + x, lat + y, ring).cast("int")
    return rows.select("id", F.round(geometry.signed_area(ring), 6).alias("area"), F.round(mean["x"], 3).alias("mid_x"), F.round(mean["y"], 3).alias("mid_y"), at(F.col("dx"), F.col("dy")).alias("probe"), at(F.col("dx"), b).alias("top"))


_REACHES = "SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS nxt, p_size AS a, p_retailprice AS f FROM part"


def _reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 1, F.floor(key / 2)).cast("long").alias("next_id"), F.col("p_size").alias("upstream_area"), F.col("p_retailprice").alias("flow"))


@query(f"""
WITH RECURSIVE n AS ({_REACHES}),
b AS (SELECT id, nxt FROM (SELECT *, row_number() OVER (PARTITION BY nxt ORDER BY a DESC, f DESC, id DESC) AS r FROM n WHERE nxt IS NOT NULL) WHERE r = 1),
t AS (SELECT id, id AS chain_id, 0 AS position FROM n WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT b.id, t.chain_id, t.position + 1 FROM b JOIN t ON b.nxt = t.id)
SELECT id, chain_id, CAST(position AS INTEGER) AS position FROM t""")
def q32_river_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains along each reach's best tributary (forest: half the key)."""
    return rivers.chains(_reaches(spark, sf_dir)).select("id", "chain_id", "position")


@query(f"""
WITH RECURSIVE n AS ({_REACHES}), t AS (SELECT id, id AS top FROM n WHERE nxt IS NULL UNION ALL SELECT n.id, t.top FROM n JOIN t ON n.nxt = t.id)
SELECT top AS system_id, count(*) AS n FROM t GROUP BY top""")
def q33_river_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reaches flow to each outlet."""
    return rivers.systems(_reaches(spark, sf_dir)).groupBy("system_id").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS lo FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM o WHERE lo <= 19970331)
SELECT CAST(o_custkey AS VARCHAR) AS object_id, o_orderkey AS ord, CAST(lo AS BIGINT) AS lo FROM a WHERE r = 1""")
def q34_active_at_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record in input order that holds the last day of a month; records are open from their day on."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("object_id"), F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    return timeline.active_at(timeline.with_bounds(rows), "1997-03").select("object_id", "ord", "lo")


@query("""
WITH p AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 2, 4) AS lon, round(CAST(embedding[2] AS DOUBLE) * 2, 4) AS lat, label AS country FROM embeddings)
SELECT a.id AS a_id, b.id AS b_id FROM p a JOIN p b ON a.country = b.country AND a.id < b.id
WHERE 12742017.6 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 5000""")
def q35_near_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one country and name within five kilometres."""
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * 2, 4).alias("lon"), F.round(e[1].cast("double") * 2, 4).alias("lat"), F.col("label").cast("string").alias("country"), F.lit("One  Name").alias("name"))
    return places.near_namesakes(rows, 5000.0).select("a_id", "b_id")
