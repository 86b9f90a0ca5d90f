"""Rasters as pixel tables (level, x, y, value): tiles, averages, heights, shades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tile_specs(levels: DataFrame) -> DataFrame:
    """levels (level, width, height, tile_size) to their tiles: column, row, pixel size and bounds in degrees, row by row."""
    rows = levels.withColumn("row", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / F.col("tile_size")).cast("int") - 1)))
    rows = rows.withColumn("column", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / F.col("tile_size")).cast("int") - 1)))
    x0, y0 = F.col("column") * F.col("tile_size"), F.col("row") * F.col("tile_size")
    x1, y1 = F.least("width", x0 + F.col("tile_size")), F.least("height", y0 + F.col("tile_size"))
    lon, lat = (lambda x: -180 + x / F.col("width") * 360), (lambda y: 90 - y / F.col("height") * 180)
    return rows.select("level", "column", "row", (x1 - x0).alias("pixel_width"), (y1 - y0).alias("pixel_height"), lon(x0).alias("west"), lat(y0).alias("north"), lon(x1).alias("east"), lat(y1).alias("south"))


def neighbour_tiles(tiles: DataFrame, columns: int, rows: int) -> DataFrame:
    """The tiles (level, column, row) around given ones, without those themselves and without any beyond the grid."""
    step = F.sequence(F.lit(-1), F.lit(1))
    near = tiles.select("level", "column", "row").withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    near = near.select("level", (F.col("column") + F.col("dx")).alias("column"), (F.col("row") + F.col("dy")).alias("row")).distinct()
    near = near.where(F.col("column").between(0, columns - 1) & F.col("row").between(0, rows - 1))
    return near.join(tiles.select("level", "column", "row"), ["level", "column", "row"], "left_anti")


def missing_neighbours(tiles: DataFrame, columns: int, rows: int) -> DataFrame:
    """tiles with the sides (W, E, N, S) on which no tile stands; columns wrap, the first and last row have no beyond."""
    present = tiles.select("level", F.col("column").alias("_c"), F.col("row").alias("_r"), F.lit(True).alias("_there"))
    sides = {"W": (-1, 0), "E": (1, 0), "N": (0, -1), "S": (0, 1)}
    asked = F.array(*(F.struct(F.lit(k).alias("side"), F.pmod(F.col("column") + dx, F.lit(columns)).alias("_c"), (F.col("row") + dy).alias("_r")) for k, (dx, dy) in sides.items()))
    each = tiles.withColumn("_s", F.explode(asked)).select(*tiles.columns, "_s.*")
    lost = each.join(present, ["level", "_c", "_r"], "left").where(F.col("_there").isNull() & F.col("_r").between(0, rows - 1))
    found = lost.groupBy("level", "column", "row").agg(F.array_sort(F.collect_set("side")).alias("fade"))
    return tiles.join(found, ["level", "column", "row"], "left").withColumn("fade", F.coalesce("fade", F.array().cast("array<string>")))


def averaged(pixels: DataFrame, factor: int) -> DataFrame:
    """The next coarser level: means of blocks of factor by factor pixels; missing values don't count."""
    return pixels.groupBy("level", F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("value").alias("value"))


def quantised_height(height: Column) -> Column:
    """Heights to steps that grow with size, halves to even steps: 16 or 32 metres above zero, 16, 64 or 128 below."""
    size = F.abs(height)
    step = F.when(height < 0, F.when(size < 256, 16.0).when(size < 1024, 64.0).otherwise(128.0)).otherwise(F.when(size < 256, 16.0).otherwise(32.0))
    rounded = F.rint(size / step) * step
    return F.when(height < 0, -rounded).otherwise(rounded).cast("long")


def hillshade(pixels: DataFrame, cell_x: float, cell_y: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """pixels with `shade` (0.42 to 1): central differences to the four neighbours, the pixel itself beyond an edge.

    The neighbours come by equi-joins on their position, so a level is spread over as many tasks as it has pixels.
    """
    here = pixels.select("level", "x", "y", F.col("value").cast("double").alias("value"))
    steps = {"w": (1, 0), "e": (-1, 0), "n": (0, 1), "s": (0, -1)}  # what a pixel is to that neighbour
    sent = here.select("level", F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(k).alias("side"), "value") for k, (dx, dy) in steps.items()))).alias("n")).select("level", "n.*")
    around = sent.groupBy("level", "x", "y").agg(*(F.max(F.when(F.col("side") == k, F.col("value"))).alias(k) for k in steps))
    rows = here.join(around, ["level", "x", "y"], "left")
    at = lambda k: F.coalesce(F.col(k), F.col("value"))
    dx, dy = (at("e") - at("w")) / (2 * cell_x), (at("n") - at("s")) / (2 * cell_y)
    a, h = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = (-dx * F.sin(a) * F.cos(h) - dy * F.cos(a) * F.cos(h) + F.sin(h)) / F.sqrt(1 + dx * dx + dy * dy)
    return rows.select("level", "x", "y", "value", (0.42 + 0.58 * F.greatest(F.lit(0.0), light)).alias("shade"))
