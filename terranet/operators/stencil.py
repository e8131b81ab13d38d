"""Grid neighbourhoods with one shuffle.

Cells are hash-partitioned by raster tile, and the cells near a tile edge are
sent to the neighbouring tile as well (the halo).  All neighbourhood columns are
then ``lag``/``lead`` windows whose partition keys contain the tile, so Spark
reuses the tile partitioning: no further shuffle, and no tile ever holds more
than ``(tile + halo)^2`` cells whatever the raster looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = 256
# rows are partitioned on the tile number alone, which no constant folding (say of a
# fixed frame_id) can take out of the keys; windows and groups add the rest
TILE_KEYS = ("tile_no", "frame_id", "tx", "ty")


def _tiles(axis: str, low: int, high: int, tile: int) -> Column:
    first = F.floor((F.col(axis) - high) / tile)
    last = F.floor((F.col(axis) - low) / tile)
    return F.explode(F.sequence(F.greatest(first, F.lit(0)), last))


def spread_to_tiles(df: DataFrame, low: int, high: int, tile: int = TILE) -> DataFrame:
    """Assign rows to every tile that needs them.

    A tile needs cells from ``low`` (<= 0) before its first row/column up to
    ``high`` after its last.  Adds tx, ty.
    """
    out = df.withColumn("tx", _tiles("x", low, high, tile)).withColumn("ty", _tiles("y", low, high, tile))
    # a fixed number, or adaptive execution would fold the few bytes of a costly stage into few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("tile_no", F.xxhash64("frame_id", "tx", "ty")).repartition(parts, "tile_no")


def at_home(tile: int = TILE) -> Column:
    """True for the one copy of a cell that lies in its own tile."""
    return (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty"))


def _shifted(axis: str, value: Column, k: int, window) -> Column:
    """Value ``k`` rows on, if that row is at position ``axis + k``; else NULL."""
    shift = F.lead if k > 0 else F.lag
    pos = F.col(axis)
    return F.when(shift(pos, abs(k)).over(window) == pos + k, shift(value, abs(k)).over(window))


def name(dx: int, dy: int) -> str:
    def part(d: int) -> str:
        return f"m{-d}" if d < 0 else f"p{d}"
    return f"n_{part(dx)}_{part(dy)}"


def scattered_neighbourhood(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """``neighbourhood`` for rasters with absent rows: every offset is looked up by position.

    One window per tile, ordered by a combined position, with a range frame per offset.
    """
    line = 1 << 32
    rows = df.withColumns({"_c": value, "_at": F.col("y").cast("long") * line + F.col("x")})
    at = Window.partitionBy(*TILE_KEYS).orderBy("_at")
    offsets = range(low, high + 1)
    return rows.withColumns({
        name(dx, dy): F.first("_c").over(at.rangeBetween(dy * line + dx, dy * line + dx)) for dx in offsets for dy in offsets
    }).drop("_c", "_at")


def neighbourhood(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """Add columns ``n_<dx>_<dy>`` holding ``value`` at every offset in [low, high]^2.

    Needs rows spread to tiles.  Positions without a row give NULL; a diagonal or
    second neighbour is seen only if the cells between exist, which is always the
    case for dense rasters.
    """
    return along_columns(along_rows(df, value, low, high), low, high)


def along_rows(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """The columns of ``neighbourhood`` with dy = 0."""
    along_x = Window.partitionBy(*TILE_KEYS, "y").orderBy("x")
    return df.withColumn("_c", value).withColumns({
        name(dx, 0): F.col("_c") if dx == 0 else _shifted("x", F.col("_c"), dx, along_x)
        for dx in range(low, high + 1)
    }).drop("_c")


def along_columns(rows: DataFrame, low: int, high: int) -> DataFrame:
    """The other columns of ``neighbourhood``, from those with dy = 0."""
    offsets = range(low, high + 1)
    along_y = Window.partitionBy(*TILE_KEYS, "x").orderBy("y")
    return rows.withColumns({
        name(dx, dy): _shifted("y", F.col(name(dx, 0)), dy, along_y)
        for dx in offsets for dy in offsets if dy != 0
    })
