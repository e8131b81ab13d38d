"""Column functions on grid coordinates and points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def in_bounds(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def clamp(value: Column, size: Column) -> Column:
    """Nearest coordinate inside [0, size)."""
    return F.greatest(F.lit(0), F.least(value, size - 1))


def half(total: Column) -> Column:
    """Integer half, rounded towards zero."""
    return F.when(total < 0, -F.floor(-total / 2)).otherwise(F.floor(total / 2)).cast("int")


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(half(x1 + x2).alias("x"), half(y1 + y2).alias("y"))


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(squared_distance(x1, y1, x2, y2).cast("double"))


def corner_coordinates(width: Column, height: Column) -> Column:
    """The four corners of a raster, clockwise from the top left."""
    zero = F.lit(0)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (
        (zero, zero), (width - 1, zero), (width - 1, height - 1), (zero, height - 1))])


def metric_length(dx: Column, dy: Column, x_res: Column, y_res: Column) -> Column:
    return F.sqrt(dx * x_res * dx * x_res + dy * y_res * dy * y_res)


def to_real_volume(volume: Column, x_res: Column, y_res: Column) -> Column:
    """Height-times-cells to cubic metres."""
    return volume * x_res * y_res


def from_real_volume(volume: Column, x_res: Column, y_res: Column) -> Column:
    return volume / (x_res * y_res)


def point(h: Column, x: Column, y: Column) -> Column:
    """Point struct; comparing structs gives the point order (h, x, y), nodata on top."""
    top = F.lit(float("inf"))
    return F.struct(F.nanvl(F.coalesce(h, top), top).alias("h"), x.cast("double").alias("x"),
                    y.cast("double").alias("y"))


def point_add(p: Column, q: Column) -> Column:
    return F.struct(*[(p[c] + q[c]).alias(c) for c in ("h", "x", "y")])


def point_subtract(p: Column, q: Column) -> Column:
    return F.struct(*[(p[c] - q[c]).alias(c) for c in ("h", "x", "y")])


def point_scale(p: Column, k: Column | float) -> Column:
    return F.struct(*[(p[c] * k).alias(c) for c in ("h", "x", "y")])
