"""Queries over the operators of hierarchies, dated tables, edits, files and tiles, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrachron.functions import geometry, numeric, segments, temporal, text
from terrachron.operators import edits, hierarchy, places, rivers, timeline
from terrachron.plans.queries import _reaches, query
from terrachron.sources.tables import table


def day(c: str) -> Column:
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("long")


_DAY = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS BIGINT)"
_LON, _LAT = "round(CAST(embedding[1] AS DOUBLE) * 300, 3)", "round(CAST(embedding[2] AS DOUBLE) * 150, 3)"
_HAVERSINE = "asin(least(1.0, sqrt(pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * 300, 3).alias("lon"), F.round(e[1].cast("double") * 150, 3).alias("lat"), "label")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in one line, each below the one before it."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 0, key - 1).alias("parent_id"), F.col("p_retailprice").alias("price"))


@query("SELECT p_partkey AS id, CAST(0 AS BIGINT) AS root_id, p_partkey AS steps, 'Valid' AS state FROM part")
def q45_deep_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and depths of one line of all parts (H1, H3, H7-H9)."""
    return hierarchy.roots(chain(spark, sf_dir))


@query("SELECT p_partkey AS id, max(p_retailprice) OVER (ORDER BY p_partkey DESC) AS price FROM part")
def q46_deep_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest price of a part and all below it in one line."""
    return hierarchy.propagate_max(chain(spark, sf_dir), "price")


_MIXED = "SELECT p_partkey AS id, CASE WHEN p_partkey <= 120 THEN p_partkey % 120 + 1 WHEN p_partkey % 3 = 0 THEN -p_partkey WHEN p_partkey % 3 = 1 THEN p_partkey // 2 END AS p FROM part"


@query(f"""
WITH RECURSIVE n AS ({_MIXED}),
t AS (SELECT id, CASE WHEN p IS NULL THEN id ELSE p END AS root_id, CASE WHEN p IS NULL THEN 'Valid' ELSE 'Missing' END AS state FROM n WHERE p IS NULL OR p < 0 UNION ALL SELECT n.id, t.root_id, t.state FROM n JOIN t ON n.p = t.id)
SELECT id, root_id, coalesce(state, 'Cycle') AS state FROM n LEFT JOIN t USING (id)""")
def q47_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long cycle and what leads into it, missing parents and sound lines."""
    k = F.col("p_partkey")
    parent = F.when(k <= 120, k % 120 + 1).when(k % 3 == 0, -k).when(k % 3 == 1, F.floor(k / 2))
    return hierarchy.roots(table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent_id"))).select("id", "root_id", "state")


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS id, 1 AS depth FROM part WHERE p_partkey IN (6, 7) UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN t ON p_partkey // 2 = id)
SELECT id, CAST(depth AS INTEGER) AS depth FROM t""")
def q48_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All below one node of a forest, with their depth (H2)."""
    return hierarchy.descendants(_reaches(spark, sf_dir).select("id", F.col("next_id").alias("parent_id")), 3)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("region").alias("kind"))
    nodes = nodes.union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("nation")))
    return nodes.union(table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("supplier")))


_TREE = "SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS p, 'region' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier' FROM supplier"


@query(f"WITH n AS ({_TREE}) SELECT a.id, b.id AS sibling_id FROM n a JOIN n b ON a.p IS NOT DISTINCT FROM b.p AND a.kind = b.kind AND a.id <> b.id")
def q49_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings, roots among themselves (H4, H5)."""
    return hierarchy.siblings(_tree(spark, sf_dir))


@query("SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS parent_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
def q50_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one kind under one root (H6)."""
    return hierarchy.selected(_tree(spark, sf_dir), kind="supplier", root="r1").select("id", "parent_id")


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN (4, 5) UNION ALL SELECT p_partkey FROM part JOIN t ON p_partkey // 2 = id AND p_partkey NOT IN (6, 7) AND p_partkey >= 8)
SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM t)""")
def q51_excluded_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaches that don't flow to two given outlets (H14); reaches 1 to 7 are outlets."""
    reaches = _reaches(spark, sf_dir).withColumn("next_id", F.when(F.col("id") >= 8, F.col("next_id")))
    return rivers.excluded_basins(reaches, spark.createDataFrame([(4,), (5,)], "id long")).select("id")


@query("SELECT p_partkey AS id, p_partkey // 2 AS next_id, CAST(row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) AS INTEGER) AS rank FROM part WHERE p_partkey > 1")
def q52_tributaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tributaries by area, flow and id."""
    return rivers.best_upstream(_reaches(spark, sf_dir)).select("id", "next_id", "rank")


@query("""
SELECT p_partkey AS id, round(p_size % 7 + 4 * log10(greatest(p_retailprice, 1e-6)) - 0.5 * log10(greatest(p_size, 1e-6)), 8) AS score,
round(greatest(0.55, least(2.6, 0.55 + 0.35 * log10(1 + greatest(p_retailprice, 0.0)))), 8) AS width FROM part""")
def q53_river_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and widths of reaches."""
    rows = _reaches(spark, sf_dir).withColumn("ord", F.col("upstream_area") % 7)
    return rivers.scored(rows).select("id", F.round("score", 8).alias("score"), F.round("width", 8).alias("width"))


@query("""
WITH n AS (SELECT user_id, event_id, event_type, value > 50 AS big, lag(event_type) OVER w AS t0, lag(value > 50) OVER w AS b0, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS chain_id, event_id, CAST(sum(CASE WHEN r = 1 OR t0 IS DISTINCT FROM event_type OR b0 IS DISTINCT FROM big THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fragment FROM n""")
def q54_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind along a chain."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain_id"), "event_id", "event_type", (F.col("value") > 50).alias("big"))
    return rivers.fragments(rows, ["event_id"], "event_type", "big").select("chain_id", "event_id", "fragment")


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_DAY.format("o_orderdate")} AS lo, {_DAY.format("o_orderdate + INTERVAL 200 DAY")} AS hi, o_orderdate AS d FROM orders)
SELECT o_orderkey, CAST(day(last_day(d)) AS INTEGER) AS days, lo <= 19971231 AND hi >= 19970101 AS meets, lo <= 19970331 AND hi >= 19970331 AS holds, lo <= 19961231 AND hi >= 19960101 AS overlaps,
{_DAY.format("d - INTERVAL 1 DAY")} AS before, lo >= 19960101 AND lo <= 19961231 AS in_common FROM o""")
def q55_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of months, tests of closed intervals, the day before."""
    lo, hi = day("o_orderdate"), day("later")
    rows = table(spark, sf_dir, "orders").withColumn("later", F.col("o_orderdate") + F.expr("interval 200 days"))
    year = temporal.parse(F.lit("1997"))
    first, last = F.lit(19960101), F.lit(19961231)
    return rows.select(
        "o_orderkey", temporal.month_days(F.year("o_orderdate"), F.month("o_orderdate")).alias("days"),
        temporal.contains(lo, hi, year["start"], year["end"]).alias("meets"), temporal.contains_end(lo, hi, temporal.month_end_key(F.lit("1997-03"))).alias("holds"),
        temporal.overlap(lo, hi, first, last).alias("overlaps"), temporal.previous_day(lo).alias("before"),
        temporal.common_overlap([lo, first, F.lit(None).cast("long")], [lo, last, F.lit(None).cast("long")]).alias("in_common"),
    )


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || ' ' WHEN 2 THEN strftime(o_orderdate, '-%Y') WHEN 3 THEN '' WHEN 4 THEN strftime(o_orderdate, '%Y-13') ELSE strftime(o_orderdate, '+%Y-%m-%d') END AS t FROM orders)
SELECT o_orderkey, o_orderkey % 6 <> 4 AS valid, CASE WHEN o_orderkey % 6 NOT IN (3, 4) THEN trim(t) END AS canonical, CASE o_orderkey % 6 WHEN 0 THEN 'date' WHEN 5 THEN 'date' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS precision FROM t""")
def q56_calendar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar texts of every precision, before the common era, blank and wrong."""
    k, of = F.col("o_orderkey") % 6, lambda f: F.date_format("o_orderdate", f)
    t = F.when(k == 0, F.concat(F.lit(" "), of("yyyy-MM-dd"))).when(k == 1, F.concat(of("yyyy-MM"), F.lit(" "))).when(k == 2, F.concat(F.lit("-"), of("yyyy"))).when(k == 3, "").when(k == 4, F.concat(of("yyyy"), F.lit("-13"))).otherwise(F.concat(F.lit("+"), of("yyyy-MM-dd")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).withColumn("p", temporal.parse(F.col("t")))
    return rows.select("o_orderkey", temporal.is_valid(F.col("t")).alias("valid"), "p.canonical", "p.precision")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("_end", F.col("o_orderdate") + F.expr("interval 300 days"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("object_id"), day("o_orderdate").alias("lo"), day("_end").alias("hi"))


_SPANS = f"SELECT o_orderkey AS id, o_custkey AS object_id, {_DAY.format('o_orderdate')} AS lo, {_DAY.format('o_orderdate + INTERVAL 300 DAY')} AS hi FROM orders"


@query(f"""
WITH s AS ({_SPANS})
SELECT id, CASE WHEN lo < 19970301 AND hi >= 19970301 THEN 'before' ELSE 'whole' END AS part, lo, CASE WHEN lo < 19970301 AND hi >= 19970301 THEN 19970228 ELSE hi END AS hi FROM s
UNION ALL SELECT id, 'after', 19970301, hi FROM s WHERE lo < 19970301 AND hi >= 19970301""")
def q57_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split at a month."""
    return timeline.split_at(_spans(spark, sf_dir), "1997-03").select("id", "part", "lo", "hi")


@query(f"WITH s AS ({_SPANS}) SELECT id, lo, least(hi, CASE WHEN hi >= 19970301 THEN 19970228 ELSE hi END) AS hi FROM s WHERE lo < 19970301")
def q58_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut off from a month on."""
    return timeline.truncate_at(_spans(spark, sf_dir), "1997-03").select("id", "lo", "hi")


@query(f"""
WITH p AS (SELECT o_custkey AS object_id, CASE WHEN o_orderkey % 2 = 0 THEN 'name' ELSE 'flag' END AS property, {_DAY.format('o_orderdate')} AS lo, {_DAY.format('o_orderdate + INTERVAL 300 DAY')} AS hi, o_orderpriority AS value FROM orders),
c AS (SELECT DISTINCT c_custkey AS object_id, 'name' AS property, c_mktsegment AS new FROM customer),
l AS (SELECT o_custkey AS object_id, {_DAY.format('min(o_orderdate)')} AS lo, {_DAY.format('max(o_orderdate) + INTERVAL 300 DAY')} AS hi FROM orders GROUP BY 1),
j AS (SELECT p.*, new, lo <= 19970331 AND hi >= 19970331 AS held FROM p LEFT JOIN c USING (object_id, property)),
t AS (SELECT *, held AND new IS NOT NULL AND new IS DISTINCT FROM value AS touched FROM j),
k AS (SELECT object_id, property, lo, CASE WHEN touched AND lo < 19970301 THEN 19970228 ELSE hi END AS hi, CASE WHEN touched AND lo >= 19970301 THEN new ELSE value END AS value FROM t UNION ALL SELECT object_id, property, 19970301, hi, new FROM t WHERE touched AND lo < 19970301),
a AS (SELECT c.object_id, c.property, greatest(19970301, l.lo) AS lo, l.hi AS until, c.new AS value, (SELECT min(p.lo) FROM p WHERE p.object_id = c.object_id AND p.property = c.property AND p.lo > 19970301) AS coming FROM c JOIN l ON c.object_id = l.object_id AND l.lo <= 19970331 AND l.hi >= 19970331 WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.object_id = c.object_id AND t.property = c.property AND t.held))
SELECT * FROM k UNION ALL SELECT object_id, property, lo, least(until, coalesce(CAST(strftime(strptime(CAST(coming AS VARCHAR), '%Y%m%d') - INTERVAL 1 DAY, '%Y%m%d') AS BIGINT), until)), value FROM a""")
def q59_set_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property set from a month on, for every object."""
    orders = table(spark, sf_dir, "orders").withColumn("_end", F.col("o_orderdate") + F.expr("interval 300 days"))
    properties = orders.select(F.col("o_custkey").alias("object_id"), F.when(F.col("o_orderkey") % 2 == 0, "name").otherwise("flag").alias("property"), day("o_orderdate").alias("lo"), day("_end").alias("hi"), F.col("o_orderpriority").alias("value"))
    lives = orders.groupBy(F.col("o_custkey").alias("object_id")).agg(F.min("o_orderdate").alias("a"), F.max("_end").alias("b")).select("object_id", day("a").alias("lo"), day("b").alias("hi"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), F.lit("name").alias("property"), F.col("c_mktsegment").alias("value"))
    return edits.set_property(properties, lives, new, "1997-03")


def _world(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    spans = _spans(spark, sf_dir).withColumn("ord", F.col("id"))
    alive = spans.where("object_id % 5 <> 0").withColumn("valid_from", F.when(F.col("object_id") % 7 != 0, F.lit("1990"))).withColumn("valid_to", F.lit(None).cast("string"))
    shapes = spans.where("object_id % 4 <> 0").select("object_id", "lo", "hi", "ord", F.concat(F.lit("g"), F.col("object_id").cast("string")).alias("geom_id"), F.col("id").alias("geom_version"))
    above = spans.where("object_id % 3 = 0").select("object_id", "lo", "hi", "ord", (F.col("object_id") - 3).alias("parent_id"))
    names = spans.select("object_id", "lo", "hi", "ord", F.lit("name").alias("property"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("value"))
    return [alive, shapes, above, names]


_ACTIVE = f"a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY id) AS r FROM ({_SPANS}) WHERE lo <= 19970331 AND hi >= 19970331) WHERE r = 1)"


@query(f"""
WITH RECURSIVE {_ACTIVE}, w AS (SELECT object_id, 'g' || object_id AS geom_id, id AS geom_version, CASE WHEN object_id % 3 = 0 THEN object_id - 3 END AS parent_id, 'N' || id AS name FROM a WHERE object_id % 5 <> 0 AND object_id % 4 <> 0),
t AS (SELECT object_id, object_id AS root_id FROM w WHERE parent_id IS NULL UNION ALL SELECT object_id, parent_id FROM w WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT object_id FROM w) UNION ALL SELECT w.object_id, t.root_id FROM w JOIN t ON w.parent_id = t.object_id)
SELECT w.*, root_id FROM w JOIN t USING (object_id)""")
def q60_world_at_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who lives with a shape in a month, under which parent and name."""
    return timeline.resolve_world(*_world(spark, sf_dir), "1997-03").select("object_id", "geom_id", "geom_version", "parent_id", "name", "root_id")


@query(f"""
WITH {_ACTIVE}
SELECT c_custkey AS object_id, CASE WHEN a.object_id IS NULL OR c_custkey % 5 = 0 THEN 'Absent' WHEN c_custkey % 4 <> 0 THEN 'Available' WHEN c_custkey % 7 <> 0 THEN 'GeometryGap' ELSE 'Unknown' END AS state FROM customer LEFT JOIN a ON object_id = c_custkey""")
def q61_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each object in a month."""
    alive, shapes, *_ = _world(spark, sf_dir)
    return timeline.availability(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id")), alive, shapes, "1997-03")


@query("""
WITH t AS (SELECT o_custkey, {d} AS k, o_orderpriority AS en, o_orderkey % 3 = 0 AS told, row_number() OVER (PARTITION BY o_custkey ORDER BY {d}, o_orderkey) AS r FROM orders)
SELECT c_custkey, coalesce(arg_max(en, r) FILTER (WHERE told AND k <= 19970331), c_name) AS name, count(*) FILTER (WHERE told AND k <= 19970331) > 0 AS evidenced
FROM customer LEFT JOIN t ON c_custkey = o_custkey GROUP BY c_custkey, c_name""".format(d=_DAY.format("o_orderdate")))
def q62_name_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at a date by a timeline of changes."""
    each = F.struct(day("o_orderdate").alias("from_key"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("en"))
    lines = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(each)).alias("timeline"))
    rows = table(spark, sf_dir, "customer").join(lines, F.col("c_custkey") == F.col("o_custkey"), "left")
    found = places.name_at(F.coalesce("timeline", F.array().cast(lines.schema["timeline"].dataType)), F.col("c_name"), "en", 19970331)
    return rows.select("c_custkey", found.alias("n")).select("c_custkey", "n.name", "n.evidenced")


@query("""
WITH e AS (SELECT o_custkey, o_orderstatus = 'P' AS provisional, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS b FROM orders WHERE o_orderkey % 3 = 0)
SELECT c_custkey AS source_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM e) OR c_custkey IN (SELECT o_custkey FROM e WHERE provisional OR (coalesce(a <= TIMESTAMP '1997-03-31', true) AND coalesce(b > TIMESTAMP '1997-03-31', true)))""")
def q63_urban_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are towns on a date."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    evidence = o.select(F.col("o_custkey").alias("source_id"), (F.col("o_orderstatus") == "P").alias("provisional"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("valid_from"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("interval 90 days")).alias("until"))
    return places.urban_at(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id")), evidence, F.lit("1997-03-31").cast("timestamp_ntz"))


@query("""
SELECT c_custkey, array_to_string(list_sort(list_distinct([x FOR x IN [c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END, 'X' || c_nationkey] IF x IS NOT NULL AND trim(x) <> ''])), '|') AS names FROM customer""")
def q64_selected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names a place may be found by."""
    k = F.col("c_custkey")
    times = F.array(F.struct(F.lit(None).cast("string").alias("ko"), F.concat(F.lit("X"), F.col("c_nationkey").cast("string")).alias("en"), F.lit("").alias("native")))
    found = places.selected_names(F.col("c_name"), F.when(k % 3 != 0, F.col("c_mktsegment")), F.when(k % 2 == 0, " ").otherwise(F.col("c_name")), F.lit(None).cast("array<string>"), times)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(found), "|").alias("names"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '  ' || upper(o_orderpriority) ELSE o_orderpriority || chr(9) END AS name FROM orders)
SELECT o_custkey, name, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(trim(replace(name, chr(9), ' '))) ORDER BY o_orderkey) AS r FROM n) WHERE r = 1""")
def q65_labels_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labels that read alike the first."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(k % 2 == 0, F.concat(F.lit("  "), F.upper("o_orderpriority"))).otherwise(F.concat("o_orderpriority", F.lit("\t"))).alias("name"), k)
    return places.labels_once(rows, "o_custkey", "name", "o_orderkey").select("o_custkey", "name", "o_orderkey")


@query("""
WITH x AS (SELECT p_partkey, p_name, chr(9) || replace(p_name, ' ', chr(9) || ' ') || ' ' AS t, 'Ⅻ ' || upper(p_name) AS u FROM part)
SELECT p_partkey, starts_with(p_name, 'small w') AS starts, contains(p_name, 'large g') AS finds, 'xii ' || p_name AS looked_up, CAST(7 * length(p_name) + 24 AS DOUBLE) AS width, '{"a":"' || p_brand || '","b":"' || p_type || '"}' AS resource,
CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE 'formal' END AS common FROM x JOIN part USING (p_partkey, p_name)""")
def q66_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts over tabs and compatibility forms, label widths, resource keys, common names."""
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    spaced = F.concat(F.lit("\t"), F.regexp_replace(n, " ", "\t "), F.lit(" "))
    names = F.struct(F.when(k == 0, F.col("p_type")).alias("ko"), F.when(k == 1, F.col("p_brand")).alias("en"), F.when(k == 2, F.array(n)).otherwise(F.array().cast("array<string>")).alias("native"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.starts(spaced, "small w").alias("starts"), text.finds(spaced, " Large  G").alias("finds"), text.place_query(F.concat(F.lit("Ⅻ "), F.upper(n))).alias("looked_up"),
        text.label_width(F.concat(n, F.lit("漢字")), 7.0, 12.0).alias("width"), text.resource_key(F.create_map(F.lit("b"), F.col("p_type"), F.lit("a"), F.col("p_brand"))).alias("resource"), text.common_name(names, F.lit("formal")).alias("common"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - l_quantity) / nullif(l_quantity, 0) * 100, 6) AS change, round(abs(ln(greatest(l_discount, 1e-9))), 8) AS error, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS half_up FROM lineitem")
def q67_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent changes, logarithmic errors, halves upwards (M4, M7, M8)."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(numeric.percent_change(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("change"), F.round(numeric.log_error(F.col("l_discount")), 8).alias("error"), numeric.half_up(F.col("l_tax") * 100).alias("half_up"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, first_value(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_orderkey + sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM l""")
def q68_delta_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from their differences (X2): each order's running quantities from its key on."""
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", F.col("m.l_quantity").cast("long").alias("q"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("s"))
    rows = rows.select("l_orderkey", "s", segments.delta_decoded(F.col("l_orderkey"), F.col("s.q")).alias("v"))
    return rows.select("l_orderkey", F.posexplode(F.slice("v", 2, 1_000_000)).alias("i", "value"), "s").select("l_orderkey", F.col("s")[F.col("i")]["l_linenumber"].alias("l_linenumber"), "value")


@query(f"""
WITH p AS (SELECT vec_id AS id, {_LON} AS x, {_LAT} AS y FROM embeddings), q AS (SELECT *, x + 3 AS x2, y + 2 AS y2 FROM p)
SELECT id, round((x + 540) % 360 - 180, 6) AS lon, round(x - 360 * floor((x - 170) / 360 + 0.5), 6) AS unwrapped,
round(12742.0176 * {_HAVERSINE.format("x", "y", "x2", "y2")}, 6) AS line_km, round(sqrt(9 + 4), 6) AS degrees,
round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(y)) * sin(radians(y2)) + cos(radians(y)) * cos(radians(y2)) * cos(radians(x2 - x)))))), 5) AS angular,
round(sqrt(pow(3 * 111.32 * cos(radians((y + y2) / 2)), 2) + pow(2 * 110.57, 2)), 6) AS local_km, CAST(floor(x * 1e7 + 0.5) AS BIGINT) AS node FROM q""")
def q69_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes, lengths and distances."""
    x, y = F.col("lon"), F.col("lat")
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 3).alias("x"), (y + 2).alias("y")))
    return points(spark, sf_dir).select(
        "id", F.round(geometry.longitude(x), 6).alias("lon"), F.round(geometry.unwrapped(x, F.lit(170.0)), 6).alias("unwrapped"), F.round(geometry.line_km(line), 6).alias("line_km"),
        F.round(geometry.length_degrees(line), 6).alias("degrees"), F.round(numeric.angular_distance(x, y, x + 3, y + 2), 5).alias("angular"), F.round(numeric.local_distance_km(x, y, x + 3, y + 2), 6).alias("local_km"), segments.quantised_node(x).alias("node"),
    )


_RING = "SELECT vec_id AS id, [round(CAST(e AS DOUBLE) * 40, 4) FOR e IN embedding[1:12]] AS v FROM embeddings"


@query(f"""
WITH p AS ({_RING}), r AS (SELECT id, i, v[2 * i - 1] AS x, v[2 * i] AS y, v[2 * (i % 6) + 1] AS x2, v[2 * (i % 6) + 2] AS y2 FROM p, range(1, 7) t(i))
SELECT id, round(sum(x * y2 - x2 * y) / 2, 5) AS signed, round(greatest(0, abs(sum(x * y2 - x2 * y) / 2) - 1), 5) AS less_hole, round(abs(sum(radians(x2 - x) * (2 + sin(radians(y)) + sin(radians(y2))))) * 6371.0088 * 6371.0088 / 2, 1) AS km2,
round(avg(x), 6) AS mid_x, round(avg(y), 6) AS mid_y, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n, CAST(count(DISTINCT (round(x, 2), round(y, 2))) AS INTEGER) AS vertices,
CAST(sum(CASE WHEN (y > 0) <> (y2 > 0) AND 0 < x + (0 - y) * (x2 - x) / nullif(y2 - y, 0) THEN 1 ELSE 0 END) % 2 AS BIGINT) AS holds_origin FROM r GROUP BY id""")
def q70_irregular_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, means, bounds and point tests of irregular rings of six vertices."""
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 40, 4)
    vertex = lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    hole = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0), corner(0.0, 0.0))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), segments.clean_ring(F.array(*map(vertex, range(6)), vertex(5))).alias("ring"))
    ring, mean, box = F.col("ring"), geometry.vertex_mean(F.col("ring")), geometry.bounds(F.col("ring"))
    return rows.select(
        "id", F.round(geometry.signed_area(ring), 5).alias("signed"), F.round(geometry.polygon_area(F.array(ring, hole)), 5).alias("less_hole"), F.round(geometry.spherical_area_km2(ring), 1).alias("km2"),
        F.round(mean["x"], 6).alias("mid_x"), F.round(mean["y"], 6).alias("mid_y"), *(box[c].alias(c) for c in "wsen"), segments.distinct_vertices(ring, 2).alias("vertices"),
        geometry.in_ring(F.lit(0.0), F.lit(0.0), ring).cast("long").alias("holds_origin"),
    )


@query(f"""
WITH p AS (SELECT vec_id AS id, {_LON} AS x, {_LAT} AS y FROM embeddings), q AS (SELECT *, x * 0.5 - 7 AS x2, y * 0.25 + 9 AS y2 FROM p),
t AS (SELECT *, greatest(0.0, least((-20 - x) / nullif(x2 - x, 0), (20 - x) / nullif(x2 - x, 0)), least((-15 - y) / nullif(y2 - y, 0), (15 - y) / nullif(y2 - y, 0))) AS a, least(1.0, greatest((-20 - x) / nullif(x2 - x, 0), (20 - x) / nullif(x2 - x, 0)), greatest((-15 - y) / nullif(y2 - y, 0), (15 - y) / nullif(y2 - y, 0))) AS b FROM q)
SELECT id, round(x + a * (x2 - x), 6) AS x1, round(y + a * (y2 - y), 6) AS y1, round(x + b * (x2 - x), 6) AS x2, round(y + b * (y2 - y), 6) AS y2, a > 0 AS cut_start, b < 1 AS cut_end FROM t WHERE a <= b""")
def q71_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut to a box."""
    x, y = F.col("lon"), F.col("lat")
    part = segments.clip_segment(x, y, x * 0.5 - 7, y * 0.25 + 9, *map(F.lit, (-20.0, -15.0, 20.0, 15.0)))
    rows = points(spark, sf_dir).select("id", part.alias("p")).where("p is not null")
    return rows.select("id", *(F.round(f"p.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")), "p.cut_start", "p.cut_end")


@query(f"""
WITH p AS (SELECT vec_id AS id, {_LON} AS x, {_LAT} AS y FROM embeddings), n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x), abs(y)) / 5.0)) AS INTEGER) AS n FROM p)
SELECT id, CAST(i AS INTEGER) AS i, round(x * i / n, 6) + 0.0 AS x, round(y * i / n, 6) + 0.0 AS y, n > ceil(abs(y) / 5.0) AS longer FROM n, range(0, 1000) t(i) WHERE i <= n""")
def q72_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the origin with steps of five degrees at most; the longer of two lines."""
    zero, end = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    line = geometry.densify(F.array(zero, end), 5.0)
    rows = points(spark, sf_dir).select("id", "lon", "lat", F.posexplode(line).alias("i", "p"))
    n = lambda c: F.ceil(F.abs(c) / 5.0)
    longer = F.greatest(F.lit(1), n(F.greatest(F.abs("lon"), F.abs("lat")))) > n(F.col("lat"))
    return rows.select("id", "i", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"), longer.alias("longer"))
