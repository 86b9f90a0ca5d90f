"""Running sums, neighbours and quantiles within keys that may hold any share of all rows: rows are dealt by ranges of (key, order).

A window over a key is one sorted task. Here each task sorts one range of a key, and only what a range adds up to is looked at
by key: a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.sources.shared import settled


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _part, the number of its range; equal keys and orders are in one range."""
    return settled(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str = "before") -> DataFrame:
    """df with the sum of `amount` over a key's earlier rows, in ascending order (nulls first); 0 at the first."""
    dealt = _dealt(df.withColumn("_amount", amount), keys, order)
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_amount").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Null keys are keys: they are compared as such.
    offsets = sums.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    on = (F.col("_part") == F.col("_p")) & F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(offsets, on).withColumn(name, F.col("_offset") + F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    return rows.select(*df.columns, name)


def following(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, value) with `next`, the next greater value of the key, and `least`, the key's least one; next is null at the last."""
    dealt = _dealt(df.select(*keys, value).distinct(), keys, [value])
    ends = dealt.groupBy("_part", *keys).agg(F.min(value).alias("_min"))
    by_key = Window.partitionBy(*keys).orderBy("_part")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", *keys, F.lead("_min").over(by_key).alias("_then"), F.min("_min").over(whole).alias("least"))
    joined = dealt.join(ends, ["_part", *keys])
    own = Window.partitionBy("_part", *keys).orderBy(value)
    return joined.select(*keys, value, F.coalesce(F.lead(value).over(own), F.col("_then")).alias("next"), "least")


def quantiles(df: DataFrame, keys: list[str], value: str, between: dict[str, float] | None = None, ranked: dict[str, float] | None = None) -> DataFrame:
    """(keys, n, one column for each quantile) of values that aren't null.

    between: names and shares, interpolated linearly between the two values next to the place. ranked: the value at the nearest rank. Equal
    values are counted together, so what is kept of a key is its distinct values, dealt by ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = settled(running(counts, keys, [value], F.col("_n"), "_before"))
    totals = placed.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum("_n").alias("n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = placed.join(totals, on)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    found = []
    for name, q in (between or {}).items():
        at = F.lit(q) * (F.col("n") - 1)
        low, high = (F.max(F.when(holds(f(at)), F.col(value))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        found.append((low + (high - low) * share).alias(name))
    for name, q in (ranked or {}).items():
        found.append(F.max(F.when(holds(F.greatest(F.ceil(F.lit(q) * F.col("n") - 1e-9) - 1, F.lit(0))), F.col(value))).alias(name))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *found)
