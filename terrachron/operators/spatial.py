"""Joins of boxes and points by grid cells: equi-joins on a cell, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions.geometry import boxes_meet
from terrachron.functions.numeric import rank_distance_km
from terrachron.operators import cells


def boxes_join(a: DataFrame, b: DataFrame, size: float, sides_too: bool = False) -> DataFrame:
    """Pairs (a_id, b_id) of boxes (id, w, s, e, n) that meet, each pair once; boxes with a null side meet nothing. With both boxes' sides (aw to bn) if asked.

    A box belongs to the first level whose cells are as large as the box, so it lies in four of them at most, and is known in the coarser
    levels that occur. A pair meets in the coarser one of its two levels, where the larger box is at home, in the cell of the
    south-west corner of the common part: small boxes never meet each other in a coarse cell, and nothing needs to be made distinct.
    """
    sides = []
    for df, side in ((a, "a"), (b, "b")):
        known = df.dropna(subset=list("wsen"))
        extent = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
        sides.append(known.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}{c}") for c in "wsen"), cells.level_of(extent, size).alias("level")))
    levels = cells.occurring(*(s.select("level") for s in sides))
    reach = [([F.col(f"{side}w"), F.col(f"{side}s")], [F.col(f"{side}e"), F.col(f"{side}n")]) for side in "ab"]
    own = [cells.own_cells(s, size, *r).drop("level") for s, r in zip(sides, reach, strict=True)]
    above = [cells.coarser_cells(s, levels, size, *r).drop("level") for s, r in zip(sides, reach, strict=True)]
    at = ["_level", "_c0", "_c1"]
    pairs = own[0].join(own[1].unionByName(above[1]), at).unionByName(above[0].join(own[1], at))
    once = cells.first_shared(size, 0, F.col("aw"), F.col("bw")) & cells.first_shared(size, 1, F.col("as"), F.col("bs"))
    meet = boxes_meet(*(F.col(f"{side}{c}") for side in "ab" for c in "wsen"))
    return pairs.where(once & meet).select("a_id", "b_id", *(f"{side}{c}" for side in "ab" for c in "wsen" if sides_too))


def neighbours(points: DataFrame, km: float) -> DataFrame:
    """Ordered pairs (id, other, distance) of points (id, lon, lat) within km of each other, also across the antimeridian and the poles.

    Cells are as high as the distance; each band of latitude is a whole turn of cells, as wide as the distance reaches at
    its far edge, or one cell where that is half a turn. A point meets the points of three bands in the cells that its own
    reach touches, counted modulo the turn.
    """
    degrees = min(km / 111.0, 180.0)
    band = F.floor(F.col("lat") / degrees)

    def reach(b: Column) -> Column:  # degrees of longitude that km spans at the band's far edge, 180 at most
        far = F.greatest(F.abs(b), F.abs(b + 1)) * degrees
        share = F.sin(F.radians(F.lit(degrees / 2))) / F.cos(F.radians(far))
        return F.when((far < 90) & (share < 1), 2 * F.degrees(F.asin(share))).otherwise(180.0)

    def turn(b: Column) -> Column:  # cells of the band
        return F.when(reach(b) < 180, F.floor(360 / reach(b))).otherwise(F.lit(1).cast("long"))

    own = turn(F.col("_band"))
    cell = lambda x: F.floor((x + 180) * own / 360)
    home = points.withColumn("_band", band).withColumn("_cell", F.pmod(cell(F.col("lon")), own))
    asked = points.select(F.col("id").alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    span = F.greatest(reach(F.col("_band")), reach(F.floor(F.col("_lat") / degrees)))
    touched = F.transform(F.sequence(cell(F.col("_lon") - span), cell(F.col("_lon") + span)), lambda c: F.pmod(c, own))
    asked = asked.withColumn("_cell", F.explode(F.array_distinct(touched)))
    pairs = asked.join(home, ["_band", "_cell"]).where(F.col("_id") != F.col("id"))
    distance = rank_distance_km(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= km).select(F.col("_id").alias("id"), F.col("id").alias("other"), "distance")


def crowding(points: DataFrame, weight: str, km: float = 200.0, decay_km: float = 65.0) -> DataFrame:
    """id, crowding: nearby points weighed by distance and by the root of their share of the point's own weight."""
    pairs = neighbours(points, km)
    own, other = points.select("id", F.col(weight).alias("_own")), points.select(F.col("id").alias("other"), F.col(weight).alias("_other"))
    each = F.exp(-F.col("distance") / decay_km) * F.least(F.lit(1.0), F.sqrt(F.col("_other") / F.greatest(F.lit(1.0), F.col("_own"))))
    sums = pairs.join(own, "id").join(other, "other").groupBy("id").agg(F.sum(each).alias("crowding"), F.count("*").alias("n"))
    return points.select("id").join(sums, "id", "left").select("id", F.coalesce("crowding", F.lit(0.0)).alias("crowding"), F.coalesce("n", F.lit(0)).alias("n"))


def tiles(df: DataFrame, columns: Column, rows: Column) -> DataFrame:
    """Each box's tiles of a grid over the world, row by row: tx, ty."""
    x = lambda c: F.least(columns - 1, F.floor((F.col(c) + 180) / 360 * columns))
    y = lambda c: F.greatest(F.lit(0), F.least(rows - 1, F.floor((90 - F.col(c)) / 180 * rows)))
    return df.withColumn("ty", F.explode(F.sequence(y("n"), y("s")))).withColumn("tx", F.explode(F.sequence(x("w"), x("e"))))
