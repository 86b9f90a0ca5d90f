"""Constraint checks as violation tables: rule, key, detail. An empty table means that the data are sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def orphans(rows: DataFrame, key: str, reference: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """Rows whose reference has no target."""
    known = targets.select(F.col(target).alias(reference)).distinct()
    lost = rows.where(F.col(reference).isNotNull()).join(known, reference, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(reference).cast("string").alias("detail"))


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return found.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.col("_n").cast("string").alias("detail"))


def overlaps(rows: DataFrame, keys: list[str], lo: str, hi: str, tie: list[str], rule: str) -> DataFrame:
    """Rows that begin before all earlier rows of their key have ended (hi excluded)."""
    w = Window.partitionBy(*keys).orderBy(lo, *tie)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    late = rows.withColumn("_reach", reach).where(F.col("_reach") > F.col(lo))
    return late.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys, *tie).alias("key"), F.col(lo).cast("string").alias("detail"))


def failing(rows: DataFrame, key: str, check: Column, detail: Column, rule: str) -> DataFrame:
    """Rows for which a check isn't true."""
    return rows.where(~F.coalesce(check, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
