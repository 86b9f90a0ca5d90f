"""What a selection by score yields at each stage, and how far that is from its aims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stage_metrics(features: DataFrame, by: list[str], score: str, length: str, thresholds: list[float]) -> DataFrame:
    """(by, stage, n, length, share): features that reach each stage's threshold; a stage holds those before it. One pass, one shuffle."""
    reached = [F.col(score) >= t for t in thresholds]
    counts = features.groupBy(*by).agg(
        F.array(*(F.struct(F.lit(i).alias("stage"), F.count_if(r).alias("n"), F.coalesce(F.sum(F.when(r, F.col(length))), F.lit(0.0)).alias("length")) for i, r in enumerate(reached))).alias("stages"),
        F.sum(length).alias("total"),
    )
    rows = counts.select(*by, "total", F.explode("stages").alias("s"))
    return rows.select(*by, "s.stage", "s.n", "s.length", F.coalesce(F.col("s.length") / F.nullif("total", F.lit(0.0)), F.lit(0.0)).alias("share"))


def accepted(ratio: Column, most: float) -> Column:
    """Whether the ratios of a group are within `most` of 1; an aggregate. Groups without ratios aren't accepted."""
    return F.coalesce(F.max(F.abs(ratio - 1)) <= most, F.lit(False))


def exact_sum(value: Column, decimals: int = 10) -> Column:
    """A sum that doesn't depend on the order of its rows, over values of so many decimals; an aggregate."""
    return F.sum(value.cast(f"decimal(28,{decimals})")).cast(f"decimal(38,{decimals})")
