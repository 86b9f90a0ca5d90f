"""Tiles of raster levels: which level, which tiles, and how tiles and pixels meet their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.operators.spatial import boxes_join

SIDES = {"west": (-1, 0), "east": (1, 0), "north": (0, -1), "south": (0, 1)}


def zoom_threshold(zoom: Column) -> Column:
    return 2.4 + 2.05 * F.log2(F.greatest(F.lit(1.0), zoom))


def size_class(width: Column, height: Column, step: int = 256) -> Column:
    return F.concat_ws("x", F.ceil(width / step), F.ceil(height / step))


def missing_sides(tiles: DataFrame) -> DataFrame:
    """tiles (tx, ty) with a flag for each side on which no tile lies. A tile tells its neighbours, so one shuffle does."""
    told = tiles.select("tx", "ty").distinct().select(F.explode(F.array(
        F.struct(F.col("tx").alias("tx"), F.col("ty").alias("ty"), F.lit("self").alias("side")),
        *(F.struct((F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty"), F.lit(side).alias("side")) for side, (dx, dy) in SIDES.items()),
    )).alias("t")).select("t.*")
    flags = told.groupBy("tx", "ty").agg(F.bool_or(F.col("side") == "self").alias("here"), *((~F.bool_or(F.col("side") == side)).alias(f"no_{side}") for side in SIDES))
    return flags.where("here").drop("here")


def with_gutters(pixels: DataFrame, width: int, height: int, tile: int, gutter: int = 1) -> DataFrame:
    """(tx, ty, px, py, value) of each tile with a border: columns wrap around the world, rows end at the poles.

    pixels: (x, y, value). Each pixel is sent to the tiles that show it, at most nine, so nothing is joined. Tiles are
    whole: width and height are multiples of `tile`.
    """
    columns, rows = width // tile, height // tile

    def places(at: str, n: int, size: int, wraps: bool) -> Column:
        """The (tile, place in it) pairs of one axis that show a pixel."""
        c, found = F.col(at), []
        for d in range(-1, 2):
            t = F.floor(c / tile) + d
            p = c - t * tile
            inside = p.between(-gutter, tile - 1 + gutter)
            found.append(F.when(inside if wraps else inside & t.between(0, n - 1), F.array(F.struct((F.pmod(t, F.lit(n)) if wraps else t).alias("t"), p.alias("p")))).otherwise(F.array()))
        if not wraps:  # the first and the last row fill what lies beyond them
            for edge, t, ps in ((0, 0, range(-gutter, 0)), (size - 1, n - 1, range(tile, tile + gutter))):
                found.append(F.when(c == edge, F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).cast("long").alias("p")) for p in ps))).otherwise(F.array()))
        return F.concat(*found)

    across = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value")
    across = across.withColumn("h", F.explode(places("x", columns, width, True))).withColumn("v", F.explode(places("y", rows, height, False)))
    return across.select(F.col("h.t").alias("tx"), F.col("v.t").alias("ty"), F.col("h.p").alias("px"), F.col("v.p").alias("py"), "value")


def level_for(levels: DataFrame, desired: Column, reserve: float = 1.12) -> DataFrame:
    """One row: the first level (level, width) that is wide enough, else the last, with `limited` set."""
    enough = F.col("width") >= reserve * desired
    best = levels.agg(F.min_by("level", F.when(enough, F.col("width"))).alias("enough"), F.max_by("level", "width").alias("last"))
    return best.select(F.coalesce("enough", "last").alias("level"), F.col("enough").isNull().alias("limited"))


def level_within(tiles: DataFrame, wanted: int, reserve: int, budget: int) -> DataFrame:
    """One row: the finest level, up to `wanted`, whose tiles (level, bytes) fit the budget beside the reserve; null if none does."""
    sums = tiles.where(F.col("level") <= wanted).groupBy("level").agg(F.sum("bytes").alias("bytes"))
    return sums.where(F.col("bytes") + reserve <= budget).agg(F.max("level").alias("level"))


def ready_or_fallback(target: DataFrame, ready: DataFrame, size: float = 1.0) -> DataFrame:
    """Ready tiles to draw: the target's own, and tiles of other levels that overlap a target tile which isn't ready.

    Both have (id, level, w, s, e, n). Boxes that overlap are found by cells of `size` and larger ones, each different box once.
    """
    box = F.struct(*"wsen").alias("id")
    missing = target.join(ready.select("id"), "id", "left_anti").select(box, *"wsen").distinct()
    own = ready.join(target.select("id"), "id", "left_semi")
    others = ready.join(target.select("id"), "id", "left_anti")
    a, b = (lambda c: F.col(f"a_id.{c}")), (lambda c: F.col(f"b_id.{c}"))
    overlap = (a("w") < b("e")) & (b("w") < a("e")) & (a("s") < b("n")) & (b("s") < a("n"))
    covered = boxes_join(others.select(box, *"wsen").distinct(), missing, size).where(overlap).select(*(a(c).alias(c) for c in "wsen")).distinct()
    other = others.join(covered, list("wsen"), "left_semi").select(*ready.columns)
    return own.withColumn("fallback", F.lit(False)).unionByName(other.withColumn("fallback", F.lit(True)))
