import pytest
from pyspark.sql import functions as F

from terrachron.functions import temporal


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def parsed(spark, text):
    return value(spark, temporal.parse(F.lit(text)))


@pytest.mark.parametrize(
    "text, precision, start, end",
    [
        ("-0001-12", "month", -1 * 10000 + 1201, -1 * 10000 + 1231),
        ("0001-01-01", "date", 10101, 10101),
        ("2000-02", "month", 20000201, 20000229),
        ("1900-02", "month", 19000201, 19000228),
        ("-0004-02", "month", -40000 + 201, -40000 + 229),
        ("1914", "year", 19140101, 19141231),
        ("+12345-06", "month", 123450601, 123450630),
        ("  1990-01-02 ", "date", 19900102, 19900102),
    ],
)
def test_parse(spark, text, precision, start, end):
    p = parsed(spark, text)
    assert (p.precision, p.start, p.end, p.canonical) == (precision, start, end, text.strip())


@pytest.mark.parametrize("text", [None, "", "0000-01", "12345", "1990-13", "1990-02-30", "1990-1", "x", "1990-01-01T00", "+1990-00"])
def test_parse_refuses(spark, text):
    assert parsed(spark, text) is None


@pytest.mark.parametrize("month, offset, out", [("-0001-12", 1, "0001-01"), ("0001-01", -1, "-0001-12"), ("1999-12", 1, "2000-01"), ("9999-12", 1, "+10000-01"), ("+999999-12", 1, None), ("2000-05", -29, "1997-12"), ("2000", 1, None)])
def test_shift_month(spark, month, offset, out):
    assert value(spark, temporal.shift_month(F.lit(month), offset)) == out


@pytest.mark.parametrize("key, out", [(-10000 + 1231, 10101), (20000228, 20000229), (20000229, 20000301), (19991231, 20000101), (9999991231, 10000000101)])
def test_following_day(spark, key, out):
    assert value(spark, temporal.following_day(F.lit(key).cast("long"))) == out


def test_intervals(spark):
    i = value(spark, temporal.interval(F.lit("-0001"), F.lit("0001")))
    assert (i.lo, i.hi) == (-10000 + 101, 11231)
    assert value(spark, temporal.interval(F.lit("1920-04"), F.lit("1920-03"))) is None
    assert value(spark, temporal.interval(F.lit(None).cast("string"), F.lit(" "))).hi == temporal.OPEN_END
    lo, hi = F.lit(19140615), F.lit(19140620)
    # A year meets an interval within it, but its last day may lie outside.
    assert value(spark, temporal.contains(lo, hi, F.lit(19140101), F.lit(19141231)))
    assert not value(spark, temporal.contains_end(lo, hi, F.lit(19141231)))
    assert value(spark, temporal.common_overlap([F.lit(3), F.lit(None).cast("int")], [F.lit(None).cast("int"), F.lit(3)]))
