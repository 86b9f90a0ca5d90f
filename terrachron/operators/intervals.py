"""Interval tables: as-of selection, islands, coverage, complements, change periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def versions(df: DataFrame, keys: list[str], start: str, tie: list[str], end: str = "valid_to") -> DataFrame:
    """Each row is valid from its start to the next row's start of its key, that excluded (null: open)."""
    w = Window.partitionBy(*keys).orderBy(start, *tie)
    return df.withColumn(end, F.lead(start).over(w))


def as_of(df: DataFrame, point: Column, start: str, end: str = "valid_to") -> DataFrame:
    """The rows whose half-open interval holds a constant point: a filter, so it reaches the scan."""
    return df.where((F.col(start) <= point) & (F.col(end).isNull() | (F.col(end) > point)))


def first_active(df: DataFrame, keys: list[str], active: Column, order: list[str]) -> DataFrame:
    """Of each key's active rows the first in input order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(active).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ambiguous(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Keys with more than one active row."""
    return df.where(active).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def islands(df: DataFrame, keys: list[str], lo: str, hi: str, touches: Column, tie: list[str]) -> DataFrame:
    """df with `island`, the number of the run of rows that touch. `touches` may use `_reach`, the greatest hi before."""
    w = Window.partitionBy(*keys).orderBy(lo, *tie)
    reach = df.withColumn("_reach", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | ~touches, 1).otherwise(0)
    return reach.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def coalesced(df: DataFrame, keys: list[str], lo: str, hi: str, touches: Column, tie: list[str]) -> DataFrame:
    """The merged intervals: keys, island, lo, hi and how many rows each has."""
    return islands(df, keys, lo, hi, touches, tie).groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n_rows"))


def gaps(df: DataFrame, keys: list[str], lo: str, hi: str, tie: list[str]) -> DataFrame:
    """What lies between a key's intervals: keys, gap_lo, gap_hi."""
    w = Window.partitionBy(*keys).orderBy(lo, *tie)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("gap_lo", reach).where(F.col("gap_lo") < F.col(lo)).select(*keys, "gap_lo", F.col(lo).alias("gap_hi"))


def elementary(df: DataFrame, keys: list[str], bounds: list[Column]) -> DataFrame:
    """The intervals between a key's neighbouring bounds: keys, lo, hi (excluded)."""
    cuts = df.select(*keys, F.explode(F.array(*bounds)).alias("lo")).where("lo is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("lo")
    return cuts.withColumn("hi", F.lead("lo").over(w)).where("hi is not null")
