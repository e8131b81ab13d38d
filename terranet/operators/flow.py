"""Descending and ascending flow: sinks of vertices, Morse cells of faces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terranet.operators import gradient as G
from terranet.operators.mesh import FACE, RIGHT, DOWN, V_PERMEABLE, bit
from terranet.operators.stencil import TILE, TILE_KEYS
from terranet.plans.forest import follow_local, jump, settle_exits, settled
from terranet.plans.scratch import cut

BOUNDARY_MINIMUM = -1

_FLOW_SCHEMA = (
    "frame_id string, w int, x int, y int, vid long, h double, flags int, vdir int, fside int,"
    " rcrit boolean, dcrit boolean, rh double, xh double, dh double,"
    " r_own long, r_up long, d_left long, d_own long,"
    " vref long, vhops long, fref long, right_v long, down_v long, r_own_f long, r_up_f long, d_left_f long, d_own_f long"
)
_PASSED = ["frame_id", "w", "x", "y", "vid", "h", "flags", "vdir", "fside", "rcrit", "dcrit",
           "rh", "xh", "dh", "r_own", "r_up", "d_left", "d_own"]


def _follow_tile(rows: pa.Table) -> pa.Table:
    """Follow both pointer forests inside one tile and look up the saddles' ends and sides."""
    col = lambda name: rows[name].to_numpy()
    vid, w = col("vid"), col("w").astype(np.int64)
    vref, vhops, (right_v, down_v) = follow_local(vid, col("vnext"), [vid + 1, vid + w])
    has_face = col("is_face")
    sides = [col(c) for c in ("r_own", "r_up", "d_left", "d_own")]
    fref = np.full(len(vid), -1, dtype=np.int64)
    fref[has_face], _, beside = follow_local(vid[has_face], col("fptr")[has_face], sides)
    out = rows.select(_PASSED)
    for name, values in (("vref", vref), ("vhops", vhops), ("fref", fref), ("right_v", right_v),
                         ("down_v", down_v), ("r_own_f", beside[0]), ("r_up_f", beside[1]),
                         ("d_left_f", beside[2]), ("d_own_f", beside[3])):
        out = out.append_column(name, pa.array(values, type=pa.int64()))
    return out


@dataclass
class Flow:
    """Gradient with both flows.  ``table`` is materialised; exits are perimeter-sized."""

    table: DataFrame
    vertex_exits: DataFrame
    face_exits: DataFrame

    def descent(self) -> DataFrame:
        """(frame_id, vid, sink, depth); sink -1 is the boundary minimum."""
        rows = jump(self.table.select("frame_id", "vid", F.col("vref").alias("ref"), F.col("vhops").alias("depth")),
                    self.vertex_exits, "ref", "depth")
        # the hop from a permeable vertex to the boundary minimum is not a mesh edge
        return rows.select("frame_id", "vid", settled("ref").alias("sink"),
                           F.when(F.col("ref") < 0, F.col("depth") - 1).otherwise(F.col("depth")).alias("depth"))

    def catchments(self) -> DataFrame:
        """Number of vertices draining to each sink."""
        return self.descent().groupBy("frame_id", "sink").agg(F.count("*").alias("n_vertices"))

    def _faces(self) -> DataFrame:
        return self.table.filter(bit("flags", FACE))

    def cell_faces(self) -> DataFrame:
        """(frame_id, fid, cell); cell -1-k is the outer cell of impermeable region k."""
        rows = jump(self._faces().select("frame_id", F.col("vid").alias("fid"), F.col("fref").alias("ref")),
                    self.face_exits, "ref")
        return rows.select("frame_id", "fid", settled("ref").alias("cell"))

    def corners(self) -> DataFrame:
        """Face corners of the bounded cells: (frame_id, cell, h, n), n = corners at that height."""
        rows = jump(self._faces().select("frame_id", "vid", F.col("fref").alias("ref"), "h", "rh", "xh", "dh"),
                    self.face_exits, "ref").filter("ref >= 0")
        return rows.select("frame_id", settled("ref").alias("cell"),
                           F.explode(F.array("h", "rh", "xh", "dh")).alias("h")
                           ).groupBy("frame_id", "cell", "h").agg(F.count("*").alias("n"))

    def minima(self) -> DataFrame:
        return G.minima(self.table)

    def maxima(self) -> DataFrame:
        return G.maxima(self.table)

    def saddles(self) -> DataFrame:
        """Saddles with the cells on both sides and the sinks of both legs.

        cell_a/sink_a belong to half-edge a->b: the cell beside it, and the sink
        of its own leg, which runs over ``b``.  cell_b/sink_b likewise for b->a.
        """
        w = F.col("w").cast("long")

        def saddle(flag, direction, step, dx, dy, other, face_a, face_b, end):
            return F.when(F.col(flag), F.struct(
                (F.col("vid") * 4 + direction).alias("saddle_id"), F.col("w").alias("w"),
                F.col("vid").alias("a"), (F.col("vid") + step).alias("b"),
                (F.col("x") + dx / 2).alias("x"), (F.col("y") + dy / 2).alias("y"),
                F.greatest("h", other).alias("h"), F.col(face_a).alias("cell_a"), F.col(face_b).alias("cell_b"),
                F.col(end).alias("sink_a"), F.col("vref").alias("sink_b")))

        rows = self.table.filter("rcrit or dcrit").select("frame_id", F.explode(F.array_compact(F.array(
            saddle("rcrit", RIGHT, F.lit(1).cast("long"), 1, 0, "rh", "r_own_f", "r_up_f", "right_v"),
            saddle("dcrit", DOWN, w, 0, 1, "dh", "d_left_f", "d_own_f", "down_v")))).alias("s")
        ).select("frame_id", "s.*")
        for column, exits in (("cell_a", self.face_exits), ("cell_b", self.face_exits),
                              ("sink_a", self.vertex_exits), ("sink_b", self.vertex_exits)):
            rows = jump(rows, exits, column).withColumn(column, settled(column))
        return rows


def flow(region: DataFrame, tile: int = TILE) -> Flow:
    """Gradient and both flows of a region: one shuffle, one written table."""
    g = G.gradient_plan(region, tile)
    w, vid = F.col("w").cast("long"), F.col("vid")
    step = (F.when(F.col("vdir") == G.RIGHT, F.lit(1)).when(F.col("vdir") == G.UP, -w)
            .when(F.col("vdir") == G.LEFT, F.lit(-1)).when(F.col("vdir") == G.DOWN, w).otherwise(F.lit(0)))
    prepared = g.select(
        *TILE_KEYS, *[c for c in _PASSED if c != "frame_id"], bit("flags", FACE).alias("is_face"),
        F.when(bit("flags", V_PERMEABLE), F.lit(BOUNDARY_MINIMUM).cast("long"))
        .otherwise((vid + step).cast("long")).alias("vnext"),
        F.coalesce("fnext", "vid").alias("fptr"))
    table = cut(prepared.groupBy(*TILE_KEYS).applyInArrow(_follow_tile, _FLOW_SCHEMA), "flow")
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    border = table.filter(edge)
    vertex_exits = settle_exits(border.select("frame_id", F.col("vid").alias("id"), F.col("vref").alias("ref"),
                                              F.col("vhops").alias("hops")))
    face_exits = settle_exits(border.filter(bit("flags", FACE)).select(
        "frame_id", F.col("vid").alias("id"), F.col("fref").alias("ref"), F.lit(0).alias("hops")))
    return Flow(table, vertex_exits, face_exits)
