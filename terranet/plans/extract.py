"""The whole pipeline: rasters in, channel networks out, all frames at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from terranet.operators import network as N, region as B
from terranet.operators.cleanup import clean_delta
from terranet.operators.flow import Flow, flow
from terranet.operators.mesh import clip, full_region
from terranet.operators.significance import MergeTree, merge_tree
from terranet.operators.stencil import TILE
from terranet.plans.scratch import cut


@dataclass
class Network:
    """Channel network of many frames.  Parts are computed when first asked for."""

    region: DataFrame
    frames: DataFrame
    rejects: DataFrame
    tile: int = TILE

    @cached_property
    def flow(self) -> Flow:
        return flow(self.region, self.tile)

    @cached_property
    def raw_saddles(self) -> DataFrame:
        return cut(self.flow.saddles(), "saddles")

    @cached_property
    def tree(self) -> MergeTree:
        return merge_tree(self.flow, self.raw_saddles, self.tile)

    @cached_property
    def saddles(self) -> DataFrame:
        """Saddles with their swept (``raw_delta``) and cleaned (``delta``) significance."""
        swept = self.raw_saddles.join(
            self.tree.saddles.select("frame_id", "saddle_id", "splits", "volume_above", "delta"),
            ["frame_id", "saddle_id"])
        swept = cut(swept, "swept")
        clean = clean_delta(swept, self.tile).select("frame_id", "saddle_id", "delta")
        return cut(swept.withColumnRenamed("delta", "raw_delta").join(clean, ["frame_id", "saddle_id"]), "saddles")

    @cached_property
    def legs(self) -> DataFrame:
        return N.legs(self.saddles)

    @cached_property
    def vertices(self) -> DataFrame:
        return N.net_vertices(self.flow.minima(), self.saddles, self.frames)

    @cached_property
    def edges(self) -> DataFrame:
        return N.net_edges(self.legs)

    def points(self, threshold: float | None = None) -> DataFrame:
        """Path points of the edges with delta >= threshold (all edges by default)."""
        kept = self.legs if threshold is None else N.filter_delta(self.legs, threshold)
        return N.leg_points(self.flow, kept, self.tile)


def extract_network(cells: DataFrame, frames: DataFrame, boundary: DataFrame | None = None,
                    regions: DataFrame | None = None, tile: int = TILE) -> Network:
    """Network of every frame, inside its boundary (frame_id, pos, x, y) if boundaries are given.

    Boundaries are turned clockwise and rasterised first; ``regions`` (frame_id,
    region_id, start_pos, end_pos) are their permeable parts, none if left out.
    Frames with nodata inside the region, without a boundary, or with one that is
    open, leaves the raster or visits a point twice, go to ``rejects``; the others are not
    held up.
    """
    rejects = None
    if boundary is not None:
        if regions is None:
            regions = boundary.select("frame_id", F.lit(0).alias("region_id"), F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos")).limit(0)
        bad = cut(bad_boundaries(boundary, frames), "rejects")
        named = [d.join(bad, "frame_id", "left_anti").withColumnRenamed("frame_id", "boundary_id") for d in (boundary, regions)]
        path, parts = B.rasterize(*B.make_clockwise(cut(named[0], "boundary"), named[1]))
        crossing = B.repeated_points(path).select(F.col("boundary_id").alias("frame_id")).distinct().select(
            "frame_id", F.lit("boundary visits a point twice").alias("error"))
        rejects = cut(bad.unionByName(crossing), "rejects")
        path, parts = (d.withColumnRenamed("boundary_id", "frame_id").join(rejects, "frame_id", "left_anti") for d in (path, parts))
        frames = frames.join(rejects, "frame_id", "left_anti")
        region = clip(cells.join(frames.select("frame_id"), "frame_id", "left_semi"), frames, path, parts)
    else:
        region = full_region(cells, frames)
    region = cut(region, "region")
    nodata = region.groupBy("frame_id").agg(
        F.max(F.col("h").isNull() | F.isnan("h")).alias("bad")).filter("bad").select(
        "frame_id", F.lit("nodata inside the region").alias("error"))
    rejects = nodata if rejects is None else rejects.unionByName(nodata)
    rejects = cut(rejects, "rejects")
    good = frames.join(rejects, "frame_id", "left_anti")
    region = region.join(rejects, "frame_id", "left_anti")
    return Network(region, good, rejects, tile)


def bad_boundaries(boundary: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, error) for frames whose boundary cannot be rasterised."""
    ends = boundary.groupBy("frame_id").agg(
        F.min_by(F.struct("x", "y"), "pos").alias("first"), F.max_by(F.struct("x", "y"), "pos").alias("last"), F.count("*").alias("n"))
    open_ = ends.filter("first <> last or n < 4").select("frame_id", F.lit("boundary is not closed").alias("error"))
    missing = frames.select("frame_id").join(ends, "frame_id", "left_anti").select("frame_id", F.lit("no boundary").alias("error"))
    outside = boundary.join(frames.select("frame_id", "width", "height"), "frame_id").filter(
        "x < 0 or y < 0 or x >= width or y >= height").select(
        "frame_id", F.lit("boundary leaves the raster").alias("error"))
    return open_.unionByName(outside).unionByName(missing).groupBy("frame_id").agg(F.min("error").alias("error"))
