"""Historical calendar values as column expressions: years of +-999999 without a year zero, at year, month or day precision.

A day is the packed number year * 10000 + month * 100 + day, which orders correctly for negative years as well.
A value covers the days from its start to its end key. Intervals are closed; a null side is open.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, functions as F

#: The text form of a calendar value, and the open sides of an interval.
PATTERN = r"^([+-]?)(\d{4,6})(?:-(\d{2})(?:-(\d{2}))?)?$"
OPEN_START, OPEN_END = -(2**63), 2**63 - 1
LAST_YEAR = 999_999


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def month_days(year: Column, month: Column) -> Column:
    """Days of a month; leap years by the Gregorian rule on the year's magnitude."""
    y = F.abs(year)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def parse(text: Column) -> Column:
    """The struct (canonical, precision, start, end) of a calendar text; null for null, blank or invalid text."""

    def of_numbers(n: Column) -> Column:
        year, m, d = n["year"], F.coalesce(n["month"], F.lit(1)), F.coalesce(n["day"], F.lit(1))
        valid = year.isNotNull() & (year != 0) & n["sound"] & m.between(1, 12) & d.between(1, month_days(year, m))
        base = year.cast("long") * 10000
        start = base + m * 100 + d
        end = F.when(n["day"].isNotNull(), start).when(n["month"].isNotNull(), base + m * 100 + month_days(year, m)).otherwise(base + 1231)
        precision = F.when(n["day"].isNotNull(), "date").when(n["month"].isNotNull(), "month").otherwise("year")
        return F.when(valid, F.struct(n["canonical"].alias("canonical"), precision.alias("precision"), start.alias("start"), end.alias("end")))

    def of_text(t: Column) -> Column:
        sign, digits, mm, dd = (F.regexp_extract(t, PATTERN, i) for i in (1, 2, 3, 4))
        number = F.when(digits != "", digits.cast("int"))
        rest = F.concat(F.when(mm != "", F.concat(F.lit("-"), mm)).otherwise(""), F.when(dd != "", F.concat(F.lit("-"), dd)).otherwise(""))
        fields = F.struct(
            F.when(sign == "-", -number).otherwise(number).alias("year"), F.when(mm != "", mm.cast("int")).alias("month"), F.when(dd != "", dd.cast("int")).alias("day"),
            ((sign != "") | (F.length(digits) == 4)).alias("sound"), F.concat(sign, digits, rest).alias("canonical"),
        )
        return let(fields, of_numbers)

    return let(F.trim(text), of_text)


class Point(NamedTuple):
    """A calendar value that is known when a query is written: its bounds become literals, which reach the scan."""

    canonical: str
    precision: str
    start: int
    end: int


def constant(text: str | None) -> Point | None:
    """What `parse` makes of a column, of one text."""
    found = re.match(PATTERN, (text or "").strip(" "), re.ASCII)
    if not found:
        return None
    sign, digits, mm, dd = (x or "" for x in found.groups())
    year, month, day = int(digits) * (-1 if sign == "-" else 1), int(mm or 1), int(dd or 1)
    if year == 0 or not (sign or len(digits) == 4) or not 1 <= month <= 12:
        return None
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    last = 28 + leap if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    if not 1 <= day <= last:
        return None
    base, precision = year * 10000, "date" if dd else "month" if mm else "year"
    start = base + month * 100 + day
    return Point(found[0], precision, start, start if dd else base + month * 100 + last if mm else base + 1231)


def constant_month_end(text: str | None) -> Column:
    """The last day of a month, as a literal; null for anything else."""
    p = constant(text)
    return F.lit(p.end if p and p.precision == "month" else None).cast("long")


def constant_start(text: str | None) -> Column:
    p = constant(text)
    return F.lit(p.start if p else None).cast("long")


def constant_end(text: str | None) -> Column:
    p = constant(text)
    return F.lit(p.end if p else None).cast("long")


def day_before(text: str | None) -> Column:
    """The last day of the month before a month, as a literal; null for anything else and at the first month of all."""
    p = constant(text)
    if not p or p.precision != "month":
        return F.lit(None).cast("long")
    year, month = p.start // 10000, p.start % 10000 // 100 - 1
    if month == 0:
        year, month = -1 if year == 1 else year - 1, 12
    return constant_month_end(f"{'-' if year < 0 else '+' if year > 9999 else ''}{abs(year):04d}-{month:02d}" if abs(year) <= LAST_YEAR else None)


def is_valid(text: Column) -> Column:
    """Whether a text is blank, null or a calendar value."""
    return text.isNull() | (F.trim(text) == "") | parse(text).isNotNull()


def month_end_key(text: Column) -> Column:
    """The last day of a value of month precision, else null."""
    return let(parse(text), lambda p: F.when(p["precision"] == "month", p["end"]))


def interval(valid_from: Column, valid_to: Column) -> Column:
    """The struct (lo, hi) of closed bounds; null if a side is invalid or the interval is reversed."""

    def of(p: Column) -> Column:
        lo, hi = F.coalesce(p["a"]["start"], F.lit(OPEN_START)), F.coalesce(p["b"]["end"], F.lit(OPEN_END))
        return F.when(p["sound"] & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))

    return let(F.struct(parse(valid_from).alias("a"), parse(valid_to).alias("b"), (is_valid(valid_from) & is_valid(valid_to)).alias("sound")), of)


def contains(lo: Column, hi: Column, point_start: Column, point_end: Column) -> Column:
    """Whether an interval meets a point's period: a coarse point is met in part."""
    return (lo <= point_end) & (hi >= point_start)


def contains_end(lo: Column, hi: Column, point_end: Column) -> Column:
    """Whether an interval holds the last day of a point's period."""
    return (lo <= point_end) & (hi >= point_end)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def following_day(key: Column) -> Column:
    """The packed day after a packed day; the year after -1 is 1."""

    def of(k: Column) -> Column:
        year = F.floor(k / 10000)
        month, day = F.floor(F.pmod(k, F.lit(10000)) / 100), F.pmod(k, F.lit(100))
        new_year = F.when(year == -1, F.lit(1)).otherwise(year + 1) * 10000 + 101
        return F.when(day < month_days(year, month), k + 1).when(month < 12, year * 10000 + (month + 1) * 100 + 1).otherwise(new_year)

    return let(key, of).cast("long")


def previous_day(key: Column) -> Column:
    """The packed day before a packed day; the year before 1 is -1."""

    def of(k: Column) -> Column:
        year = F.floor(k / 10000)
        month, day = F.floor(F.pmod(k, F.lit(10000)) / 100), F.pmod(k, F.lit(100))
        old_year = F.when(year == 1, F.lit(-1)).otherwise(year - 1) * 10000 + 1231
        return F.when(day > 1, k - 1).when(month > 1, year * 10000 + (month - 1) * 100 + month_days(year, month - 1)).otherwise(old_year)

    return let(key, of).cast("long")


def shift_month(text: Column, offset: Column | int) -> Column:
    """A month so many months away, as text; null if it isn't a month or leaves the range of years."""
    offset = F.lit(offset) if isinstance(offset, int) else offset

    def of_months(months: Column) -> Column:
        year = F.floor(months / 12)
        historic = F.when(year > 0, year).otherwise(year - 1)
        digits = F.abs(historic).cast("string")
        prefix = F.when(historic < 0, "-").when(historic > 9999, "+").otherwise("")
        out = F.concat(prefix, F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")), F.lit("-"), F.lpad((F.pmod(months, F.lit(12)) + 1).cast("string"), 2, "0"))
        return F.when(F.abs(historic) <= LAST_YEAR, out)

    def of_point(p: Column) -> Column:
        year = F.floor(p["start"] / 10000)
        months = F.when(year > 0, year).otherwise(year + 1) * 12 + F.floor(F.pmod(p["start"], F.lit(10000)) / 100) - 1 + offset
        return F.when(p["precision"] == "month", let(months, of_months))

    return let(parse(text), of_point)


def common_overlap(starts: list[Column], ends: list[Column]) -> Column:
    """Whether several intervals have a day in common; null sides are open."""
    return F.coalesce(F.greatest(*starts) <= F.least(*ends), F.lit(True))
