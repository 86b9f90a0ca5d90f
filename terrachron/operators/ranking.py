"""Top-k, ranks, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.operators import ranges


def top(df: DataFrame, k: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first k rows, and one row `truncated` telling whether there were more."""
    more = df.orderBy(*order).limit(k + 1)
    return df.orderBy(*order).limit(k), more.agg((F.count("*") > k).alias("truncated"))


def top_per_group(df: DataFrame, keys: list[str], k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def stage(value: Column, thresholds: list[float]) -> Column:
    """The number of the first threshold (from the greatest) that a value reaches, from 1; null below all."""
    out = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(thresholds, 1))):
        out = F.when(value >= t, i).otherwise(out)
    return out


def profile(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """df with `reached`, the sum of lengths up to and with each row, and `total`, the key's sum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("reached", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(length).over(Window.partitionBy(*keys)))


def bounds_on_circle(df: DataFrame, key: str, lon: str) -> DataFrame:
    """key, west, east: the smallest arc with all of a key's longitudes; its outside is the largest gap (the first of equal ones)."""
    gaps = ranges.following(df.select(key, F.col(lon).alias("_x")), [key], "_x").withColumn("_next", F.coalesce("next", F.col("least") + 360))
    best = gaps.groupBy(key).agg(F.max_by(F.struct("_x", "_next"), F.struct((F.col("_next") - F.col("_x")).alias("g"), (-F.col("_x")).alias("x"))).alias("b"))
    west = F.when(F.col("b._next") >= 180, F.col("b._next") - 360).otherwise(F.col("b._next"))
    return best.select(key, west.alias("west"), F.col("b._x").alias("east"))
