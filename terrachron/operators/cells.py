"""Finding what meets by cells of doubling size: one equi-join, whatever the mixture of small and large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Cells grow by this factor from level to level.
GROWTH = 4.0


def level_of(extent: Column, size: float) -> Column:
    """The first level whose cells are as large as an extent; level 0 has cells of `size`."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(extent.cast("double"), F.lit(float(size))) / size) / F.log(F.lit(GROWTH)) - 1e-9)).cast("int")


def cell_size(level: Column, size: float) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(GROWTH), level)


def occurring(*levels: DataFrame) -> DataFrame:
    """One row: the levels that occur in tables (level), some dozens at most."""
    found = levels[0]
    for other in levels[1:]:
        found = found.union(other)
    return found.agg(F.collect_set("level").alias("_levels"))


def own_cells(df: DataFrame, size: float, low: list[Column], high: list[Column]) -> DataFrame:
    """Each row with its level's cells (_level, _c0, ...): at most two on each axis."""
    out = df.withColumn("_level", F.col("level"))
    return _spread(out, size, low, high)


def coarser_cells(df: DataFrame, levels: DataFrame, size: float, low: list[Column], high: list[Column]) -> DataFrame:
    """Each row with the cells of the levels above its own that occur."""
    out = df.crossJoin(F.broadcast(levels))  # one row
    out = out.withColumn("_level", F.explode(F.filter("_levels", lambda x: x > F.col("level")))).drop("_levels")
    return _spread(out, size, low, high)


def _spread(df: DataFrame, size: float, low: list[Column], high: list[Column]) -> DataFrame:
    step = cell_size(F.col("_level"), size)
    for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
        df = df.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))
    return df


def first_shared(size: float, axis: int, low_a: Column, low_b: Column) -> Column:
    """Whether this cell is the first on an axis that holds both: a pair meets once."""
    return F.col(f"_c{axis}") == F.floor(F.greatest(low_a, low_b) / cell_size(F.col("_level"), size))
