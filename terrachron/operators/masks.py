"""Polygons as runs of pixels, and pixels without a value filled from the nearest one that has one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def pixel_runs(rings: DataFrame) -> DataFrame:
    """(id, y, x1, x2): the pixels whose middles lie in the rings (id, ring; in pixels) of an id, row by row, from x1 to x2 (even-odd, so holes are left out).

    Each edge tells the rows whose middle lines it crosses where it does; of the crossings of a row every second one ends a run. A middle on
    an edge belongs to the polygon to its right (and above).
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i - 1).alias("p"), F.get("ring", i).alias("q")))
    e = rings.where(F.size("ring") > 1).select("id", F.explode(steps).alias("s")).select("id", *(F.col(f"s.{p}.{c}").alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy")).dropna()
    first, last = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1
    rows = e.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("id", "y").orderBy("at")
    cut = rows.select("id", "y", at.alias("at")).withColumns({"i": F.row_number().over(w), "to": F.lead("at").over(w)}).where("i % 2 = 1 and to is not null")
    runs = cut.select("id", "y", F.ceil(F.col("at") - 0.5).alias("x1"), (F.ceil(F.col("to") - 0.5) - 1).alias("x2"))
    return runs.where("x1 <= x2")


def _across(rows: pa.Array) -> pa.Array:
    """For each pixel of rows of (x, y of the nearest known pixel in its column): the nearest of all, by distance, then y, then x.

    Columns at a growing distance are looked at, for all rows of a batch at once, until none can be nearer.
    """
    flat = rows.flatten()
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    x, y, seed = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "seed"))
    far = np.iinfo(np.int64).max
    known = ~np.isnan(seed)
    down = np.where(known, seed, 0).astype(np.int64)
    up = np.where(known, np.abs(down - y) ** 2, far)
    row = np.repeat(np.arange(len(rows)), lengths)
    best, best_y, best_x = up.copy(), down.copy(), x.copy()
    step, n = 1, len(x)
    while True:
        if not ((best > step * step) & (best < far)).any() and not (best == far).any():
            break
        moved = False
        for to in (-step, step):
            a, b = (np.arange(step, n), np.arange(n - step)) if to < 0 else (np.arange(n - step), np.arange(step, n))
            ok = (row[a] == row[b]) & known[b] if len(a) else np.zeros(0, bool)
            moved |= bool(len(a)) and bool((row[a] == row[b]).any())
            a, b = a[ok], b[ok]
            d = up[b] + (x[a] - x[b]) ** 2
            nearer = (d < best[a]) | ((d == best[a]) & ((down[b] < best_y[a]) | ((down[b] == best_y[a]) & (x[b] < best_x[a]))))
            a, b = a[nearer], b[nearer]
            best[a], best_y[a], best_x[a] = d[nearer], down[b], x[b]
        if not moved:
            break
        step += 1
    none = best == far
    found = pa.StructArray.from_arrays([pa.array(x), pa.array(best_x, mask=none), pa.array(best_y, mask=none), pa.array(best, mask=none)], ["x", "sx", "sy", "d2"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), found)


def filled(pixels: DataFrame) -> DataFrame:
    """(x, y, value, sx, sy): pixels (x, y, value) in which a null value is that of the nearest pixel with one, at (sx, sy); ties go to the lesser y, then the lesser x.

    Exact in two steps: the nearest known pixel of each column, by a window along it, and then the nearest of a row's columns. A task
    holds rows of the raster, never the whole. Without any known pixel values stay null. Each place occurs once, rows have no gaps.
    """
    by = Window.partitionBy("x").orderBy("y")
    known = F.when(F.col("value").isNotNull(), F.col("y"))
    above = F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # Downwards, the first known one ahead is the last one seen: a frame that ends with its partition is gone through again for each row.
    down = Window.partitionBy("x").orderBy(F.desc("y"))
    below = F.last(known, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    nearer: Column = F.when(below.isNull() | (F.col("y") - above <= below - F.col("y")), above).otherwise(below)
    seeded = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value").withColumn("seed", nearer)
    rows = seeded.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "y", F.col("seed").cast("double").alias("seed")))).alias("row"))
    found = F.arrow_udf(_across, "array<struct<x:long,sx:long,sy:long,d2:long>>")(F.col("row"))
    placed = rows.select("y", F.explode(found).alias("f")).select("f.x", "y", "f.sx", "f.sy")
    values = seeded.where("value is not null").select(F.col("x").alias("sx"), F.col("y").alias("sy"), "value")
    return placed.join(values, ["sx", "sy"], "left").select("x", "y", "value", "sx", "sy")
