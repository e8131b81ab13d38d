"""Operators on raster cells (frame_id, x, y, h); NULL h is nodata.

A position without a row is nodata as well.  Neighbourhood operators use one tile shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from terranet.functions.points import point
from terranet.operators.stencil import TILE, at_home, name, scattered_neighbourhood, spread_to_tiles

_EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
# 4-neighbours counter-clockwise: right, up, left, down
_FOUR = [(1, 0), (0, -1), (-1, 0), (0, 1)]


def _around(cells: DataFrame, value: Column, tile: int) -> DataFrame:
    """Cells with their 3x3 neighbourhood of ``value``."""
    return scattered_neighbourhood(spread_to_tiles(cells, -1, 1, tile), value, -1, 1).filter(at_home(tile))


def elevation_at(cells: DataFrame, coords: DataFrame) -> DataFrame:
    """Elevation at given (frame_id, x, y); NULL where there is no data or no cell."""
    return coords.join(cells, ["frame_id", "x", "y"], "left")


def with_elevation(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace elevations at the (unique) coordinates of ``updates``; a NULL h there sets nodata."""
    new = updates.select("frame_id", "x", "y", F.col("h").alias("_h"), F.lit(True).alias("_set"))
    return cells.join(new, ["frame_id", "x", "y"], "left").select(
        "frame_id", "x", "y", F.when(F.col("_set"), F.col("_h")).otherwise(F.col("h")).alias("h"))


def elevation_range(cells: DataFrame) -> DataFrame:
    """Lowest and highest elevation per frame, and of the series (frame_id NULL)."""
    return cells.rollup("frame_id").agg(F.min("h").alias("min_h"), F.max("h").alias("max_h"))


def contains_nodata(cells: DataFrame) -> DataFrame:
    return cells.groupBy("frame_id").agg(F.max(F.col("h").isNull() | F.isnan("h")).alias("has_nodata"))


def neighbours(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """4-neighbours with their direction (0 right, 1 up, 2 left, 3 down): dir, nx, ny, nh."""
    rows = _around(cells, F.struct("h"), tile)
    found = F.array_compact(F.array(*[
        F.when(F.col(name(dx, dy)).isNotNull(), F.struct(
            F.lit(d).alias("dir"), (F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny"),
            F.col(name(dx, dy))["h"].alias("nh"))) for d, (dx, dy) in enumerate(_FOUR)]))
    return rows.select("frame_id", "x", "y", "h", F.explode(found).alias("n")).select("frame_id", "x", "y", "h", "n.*")


def steepest_neighbour(nbrs: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Neighbour with the smallest rise per distance; ties go to the lower point.

    Distances are in cells, or in units with the resolution of ``frames``.  Nodata
    cells, and cells with only such neighbours, have none.
    """
    nbrs = nbrs.filter("h is not null and nh is not null and not isnan(h) and not isnan(nh)")
    dx, dy = (F.col("nx") - F.col("x")).cast("double"), (F.col("ny") - F.col("y")).cast("double")
    if frames is not None:
        nbrs = nbrs.join(frames.select("frame_id", "x_res", "y_res"), "frame_id")
        dx, dy = dx * F.col("x_res"), dy * F.col("y_res")
    rise = (F.col("nh") - F.col("h")) / F.sqrt(dx * dx + dy * dy)
    best = nbrs.groupBy("frame_id", "x", "y").agg(F.min(F.struct(
        rise.alias("slope"), point(F.col("nh"), F.col("nx"), F.col("ny")).alias("p"), "dir", "nx", "ny", "nh")).alias("b"))
    return best.select("frame_id", "x", "y", "b.dir", "b.nx", "b.ny", "b.nh", "b.slope")


def hillshade(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Brightness factor from the diagonal height difference, at most 3; NULL on the rim."""
    rows = _around(cells, F.col("h"), tile)
    rise = F.col(name(1, 1)) - F.col(name(-1, -1))
    return rows.select("frame_id", "x", "y", (F.when(rise.isNotNull(), F.least(rise, F.lit(2.0))) + 1).alias("shade"))


def water(cells: DataFrame, level: Column | float) -> DataFrame:
    """Cells below the water level, with their depth."""
    level = level if isinstance(level, Column) else F.lit(float(level))
    return cells.filter(F.col("h") < level).select("frame_id", "x", "y", (level - F.col("h")).alias("depth"))


def _outline(cells: DataFrame, value: Column, tile: int) -> DataFrame:
    rows = _around(cells, value, tile)
    here = F.col(name(0, 0))
    differs = reduce(lambda p, q: p | q, [F.coalesce(F.col(name(*o)) != here, F.lit(False)) for o in _EIGHT])
    return rows.filter(differs).select("frame_id", "x", "y", "h")


def contour(cells: DataFrame, level: Column | float, mask: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Cells on the iso-contour: some 8-neighbour lies on the other side of ``h <= level``.

    With a ``mask`` (frame_id, x, y) only cells of the mask are kept.
    """
    out = _outline(cells, F.col("h") <= level, tile)
    return out if mask is None else out.join(mask, ["frame_id", "x", "y"], "left_semi")


def contours(cells: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Cells on any of ``n`` evenly spaced contours between the frame's extremes."""
    span = cells.groupBy("frame_id").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi"))
    flat = F.col("_hi") == F.col("_lo")
    band = F.when(~flat, (F.lit(n) * (F.col("h") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("int"))
    banded = cells.join(span, "frame_id").withColumn("band", band).drop("_lo", "_hi")
    return _outline(banded, F.col("band"), tile)
