"""Rasters derived from the benchmark tables (see SURVEY, section 7.3).

Every function returns ``(cells, frames)``.  ``cells`` has one row per raster
position (frame_id, x, y, h); nodata is NULL, or an absent row where noted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _frames(cells: DataFrame) -> DataFrame:
    sizes = cells.groupBy("frame_id").agg(
        (F.max("x") + 1).cast("int").alias("width"),
        (F.max("y") + 1).cast("int").alias("height"),
    )
    return sizes.select(
        "frame_id", F.lit(0).alias("frame_no"), "width", "height",
        F.lit(1.0).alias("x_res"), F.lit(1.0).alias("y_res"),
    )


def embeddings_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One 64-column raster: x = position in the vector, y = vec_id."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    cells = emb.select(
        F.lit("emb").alias("frame_id"),
        F.col("vec_id").cast("int").alias("y"),
        F.posexplode("embedding").alias("x", "value"),
    ).select("frame_id", "x", "y", F.floor(F.col("value").cast("double") * 1e6).cast("double").alias("h"))
    return cells, _frames(cells)


def events_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One frame per event type: x = hour, y = day since the first event of the table, empty cells are 0."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    first, days = ev.agg(F.to_date(F.min("ts")), F.datediff(F.max("ts"), F.min("ts"))).first()
    filled = ev.select(
        F.col("event_type").alias("frame_id"),
        F.hour("ts").alias("x"),
        F.datediff("ts", F.lit(first)).alias("y"),
        F.col("value").cast("decimal(12,2)").alias("v"),
    ).groupBy("frame_id", "x", "y").agg((F.sum("v") * 100).cast("double").alias("h"))
    grid = ev.select(F.col("event_type").alias("frame_id")).distinct().select(
        "frame_id", F.explode(F.sequence(F.lit(0), F.lit(days or 0))).alias("y")
    ).select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x"), "y")
    cells = grid.join(filled, ["frame_id", "x", "y"], "left").select(
        "frame_id", "x", "y", F.coalesce("h", F.lit(0.0)).alias("h"))
    return cells, _frames(cells)


def lineitem_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sparse raster, absent rows are nodata: x = supplier, y = part, h = revenue in cents."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_extendedprice")
    cells = li.groupBy(
        F.col("l_suppkey").cast("int").alias("x"), F.col("l_partkey").cast("int").alias("y"),
    ).agg((F.sum(F.col("l_extendedprice").cast("decimal(15,2)")) * 100).cast("double").alias("h"))
    cells = cells.select(F.lit("li").alias("frame_id"), "x", "y", "h")
    return cells, _frames(cells)
