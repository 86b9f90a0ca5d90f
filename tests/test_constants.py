"""Constant calendar values agree with those of columns, and reach the scan."""

import itertools

from pyspark.sql import functions as F

from terrachron.functions import temporal
from terrachron.operators import timeline

TEXTS = [None, "", "1997", "1997-02", "1996-02-29", "1997-02-29", "-0001-01", "0001-01", "0000", "+12345-06", "12345-06", "-0044-03-15", "1997-13", "1997-00", "x", " 1997-03 ", "999999-12", "+999999-12", "-999999-01", "0004-02", "-0004-02", "-0005-02", "1900-02", "2000-02"]


def test_equal_to_columns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", temporal.parse(F.col("t")).alias("p"), temporal.month_end_key(F.col("t")).alias("m"), temporal.month_end_key(temporal.shift_month(F.col("t"), -1)).alias("b")).collect()
    for r in rows:
        p = temporal.constant(r.t)
        assert (tuple(r.p) if r.p else None) == (tuple(p) if p else None), r.t
        one = spark.range(1).select(temporal.constant_month_end(r.t).alias("m"), temporal.day_before(r.t).alias("b"), temporal.constant_start(r.t).alias("s"), temporal.constant_end(r.t).alias("e")).first()
        assert (one.m, one.b) == (r.m, r.b), r.t
        assert (one.s, one.e) == ((r.p.start, r.p.end) if r.p else (None, None))


def test_bounds_are_pushed_down(spark, tmp_path):
    days = spark.createDataFrame([(i, 19960101 + i, 19981231, i) for i in range(10)], "object_id long, lo long, hi long, ord long")
    days.write.parquet(str(tmp_path / "d"))
    plan = timeline.active_at(spark.read.parquet(str(tmp_path / "d")), "1997-03")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert "LessThanOrEqual(lo,19970331)" in pushed and "GreaterThanOrEqual(hi,19970331)" in pushed


def test_all_months_of_some_years(spark):
    for year, month in itertools.product((-1, 1, 4, 1997, 10000), range(1, 13)):
        text = f"{'-' if year < 0 else '+' if year > 9999 else ''}{abs(year):04d}-{month:02d}"
        p = temporal.constant(text)
        assert p.start == year * 10000 + month * 100 + 1 and p.precision == "month"
