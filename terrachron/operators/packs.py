"""Packed files and tile levels: reads put together, features in a box, edges of tiles, weights of a resampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrachron.functions.temporal import let
from terrachron.sources.shared import dealt, spread


def coalesced_reads(packs: DataFrame, gap: int = 32 * 1024, span: int = 1024 * 1024) -> DataFrame:
    """packs (shard, offset, length) with `start`, the first byte of the read that fetches the pack.

    A read goes on over gaps of at most `gap` bytes while it spans at most `span`. A shard is read in order of its
    offsets by one task that holds only the open read, so the size of a shard is no matter of memory.
    """
    names = ["shard", "offset", "length"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, start, end = None, 0, 0
        for batch in batches:
            starts = []
            for s, offset, length in zip(*(batch[c].tolist() for c in names)):
                stop = offset + length
                if s != shard or offset - end > gap or stop - start > span:
                    shard, start, end = s, offset, stop
                else:
                    end = max(end, stop)
                starts.append(start)
            yield batch.assign(start=starts)

    rows = packs.repartition("shard").sortWithinPartitions(*names)
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("start", T.LongType())]))


def features_in_box(features: DataFrame, category: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Distinct logical ids of a category's features (w, s, e, n in millionths) that meet a box: filters that reach the scan."""
    box = (F.col("w") <= round(east * 1e6)) & (F.col("e") >= round(west * 1e6)) & (F.col("s") <= round(north * 1e6)) & (F.col("n") >= round(south * 1e6))
    return features.where((F.col("category") == category) & box).select("logical_id").distinct()


def edge_mismatches(tiles: DataFrame, columns: int, rows: int) -> DataFrame:
    """Sides on which tiles (col, row, width, height, data: pixels by rows, a border of one) differ from their neighbours.

    Returns col, row, side (east, south, top, bottom). Columns close into a ring; the border of the first and last row
    repeats the row beside it. A missing neighbour is a difference.
    """
    w, h, data = F.col("width"), F.col("height"), F.col("data")
    column = lambda x: F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.get(data, (y * w + x).cast("int")))
    line = lambda y: F.slice(data, (y * w + 1).cast("int"), w)
    edges = dealt(tiles, "col", "row").select("col", "row", *(column(x).alias(n) for n, x in (("w0", F.lit(0)), ("w1", F.lit(1)), ("e1", w - 2), ("e0", w - 1))), *(line(y).alias(n) for n, y in (("n0", F.lit(0)), ("n1", F.lit(1)), ("s1", h - 2), ("s0", h - 1))))
    west = edges.select(((F.col("col") - 1 + columns) % columns).alias("col"), "row", F.col("w0").alias("x0"), F.col("w1").alias("x1"))
    north = edges.select("col", (F.col("row") - 1).alias("row"), F.col("n0").alias("y0"), F.col("n1").alias("y1"))
    # Files of tiles may pack well, and their edges then pass for small: they are never sent whole to a task.
    both = edges.join(spread(west), ["col", "row"], "left").join(spread(north), ["col", "row"], "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    wrong = {
        "east": ~(same("e0", "x1") & same("e1", "x0")), "south": (F.col("row") < rows - 1) & ~(same("s0", "y1") & same("s1", "y0")),
        "top": (F.col("row") == 0) & ~same("n0", "n1"), "bottom": (F.col("row") == rows - 1) & ~same("s0", "s1"),
    }
    return both.select("col", "row", F.explode(F.array_compact(F.array(*(F.when(c, side) for side, c in wrong.items())))).alias("side"))


def _lobe(x: Column, kind: str) -> Column:
    a = F.abs(x)
    if kind == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if kind == "bicubic":
        return F.when(a < 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(F.pi() * v) / (F.pi() * v))
    return F.when((x >= -3) & (x < 3), sinc(x) * sinc(x / 3)).otherwise(0.0)


def resample_weights(size: Column, out_size: Column, index: Column, kind: str) -> Column:
    """The struct (start, weights) of an output pixel: its first input pixel and shares in units of 2^-22.

    kind: bilinear (radius 1), bicubic (2) or lanczos (3), as wide as an output pixel where the image shrinks.
    """
    scale = size / out_size
    wide = F.greatest(F.lit(1.0), scale)
    radius = {"bilinear": 1, "bicubic": 2, "lanczos": 3}[kind] * wide
    centre = (index + 0.5) * scale
    start = F.greatest(F.lit(0), (centre - radius + 0.5).cast("int"))
    stop = F.least(size.cast("int"), (centre + radius + 0.5).cast("int"))
    values = F.transform(F.sequence(start, stop - 1), lambda j: _lobe((j - centre + 0.5) / wide, kind))
    # The values, and then their sum, are computed once.
    summed = let(values, lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total")))
    shares = let(summed, lambda s: F.transform(s["v"], lambda v: F.round(F.when(s["total"] == 0, v).otherwise(v / s["total"]) * (1 << 22)).cast("long")))
    return F.struct(start.alias("start"), shares.alias("weights"))
