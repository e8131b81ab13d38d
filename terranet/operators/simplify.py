"""Simplification of the gradient: insignificant saddles are cancelled with maxima.

Saddles below a significance are taken from high to low.  One whose two sides lead to
different maxima is cancelled with the maximum of its lighter side: the path of faces
from the saddle up to it is turned round.  In ties the lighter side is that of ``cell_b``,
and the outer face, which is one here, never loses.

Turning paths round only changes which maximum a tree of cells leads to, so nothing is
done step by step.  The cancelled saddles are the maximum spanning forest of the cells
under the insignificant saddles.  A cell keeps its maximum unless it is on the lighter side
of one of them: its place in the merge tree lies in no lighter subtree, a running sum over
an Euler tour.  A second tour, of the forest itself, starts at the cells that remain and so
tells every other cell over which saddle it now drains.  From the face beside this saddle
the old path to the maximum is turned round, tile by tile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from terranet.operators import gradient as G
from terranet.operators.flow import Flow
from terranet.operators.mesh import DOWN, LEFT, RIGHT, UP
from terranet.operators.significance import MergeTree, merge_tree_of
from terranet.operators.stencil import TILE
from terranet.plans.lists import rank_lists
from terranet.plans.ordered import following, sums_before
from terranet.plans.paths import entries, pieces
from terranet.plans.scratch import cut
from terranet.plans.tours import DOWN as INTO, intervals, tour

OUTER = -1


@dataclass
class Simplified:
    """``pairs`` (frame_id, fid, paired_hid) of the simplified gradient; ``cancelled`` (frame_id, saddle_id); ``lost`` (frame_id, cell), the cells without their maximum."""

    pairs: DataFrame
    cancelled: DataFrame
    lost: DataFrame


def lighter_sides(saddles: DataFrame, tree: MergeTree) -> DataFrame:
    """(frame_id, saddle_id, light_a): the side of ``cell_a`` holds less sand above the saddle than the other."""
    own = tree.paths.filter("b = 0").select("frame_id", F.col("v").alias("cell_a"), "path")
    splits = tree.saddles.filter("splits").select("frame_id", "saddle_id", "group_v", "group_b", "group_volume", "other_volume")
    rows = saddles.select("frame_id", "saddle_id", "cell_a").join(splits, ["frame_id", "saddle_id"]).join(own, ["frame_id", "cell_a"], "left")
    a_in_group = F.coalesce(F.exists("path", lambda p: (p["v"] == F.col("group_v")) & (p["b"] == F.col("group_b"))), F.lit(False)) | (
        (F.col("group_b") == 0) & (F.col("group_v") == F.col("cell_a")))
    lighter = F.when(a_in_group, F.col("group_volume") < F.col("other_volume")).otherwise(F.col("other_volume") < F.col("group_volume"))
    return rows.select("frame_id", "saddle_id", lighter.alias("light_a"))


def _turned(tree: MergeTree, light: DataFrame) -> DataFrame:
    """(frame_id, cell): cells on the lighter side of a cancelled saddle.  ``light`` (frame_id, saddle_id, cell) names a cell of that side."""
    inner = tree.parents.select("frame_id", (F.col("saddle_id") * 2).alias("id"), (F.col("parent_id") * 2).alias("parent"))
    leaves = tree.leaves.select("frame_id", (F.col("cell") * 2 + 1).alias("id"), (F.col("parent_id") * 2).alias("parent"))
    nodes = cut(inner.unionByName(leaves), "tree")
    arcs = tour(nodes)
    places = cut(intervals(arcs), "intervals")
    at = places.select("frame_id", "node", "tail", "high")
    outer = at.filter(F.col("node") == 2 * OUTER + 1).select("frame_id", F.col("tail").alias("outer_tail"), F.col("high").alias("outer_at"))
    lit = light.select("frame_id", (F.col("saddle_id") * 2).alias("parent"), (F.col("cell") * 2 + 1).alias("node")).join(at, ["frame_id", "node"]).select(
        "frame_id", "parent", F.col("high").alias("light_at"))
    above = places.select("frame_id", F.col("node").alias("parent"), F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    children = nodes.filter("parent is not null").join(places.withColumnRenamed("node", "id"), ["frame_id", "id"]).join(lit, ["frame_id", "parent"]).join(
        above, ["frame_id", "parent"]).join(outer, "frame_id", "left")
    holds_outer = lambda low, high: F.coalesce((F.col("tail") == F.col("outer_tail")) & F.col("outer_at").between(F.col(low), F.col(high)), F.lit(False))
    loses = F.when(holds_outer("p_low", "p_high"), ~holds_outer("low", "high")).otherwise(F.col("light_at").between(F.col("low"), F.col("high")))
    losing = children.filter(loses).select("frame_id", F.col("id").alias("node"), F.lit(1).cast("long").alias("w"))
    marked = arcs.join(losing, ["frame_id", "node"], "left").withColumn("w", F.coalesce("w", F.lit(0)) * F.when(F.col("way") == INTO, 1).otherwise(-1))
    sums = sums_before(cut(marked, "marked"), ["frame_id", "tail"], [F.col("to_end").desc()], ["w"])
    return sums.filter((F.col("way") == INTO) & (F.pmod("node", F.lit(2)) == 1) & (F.col("w") + F.col("w_before") > 0)).select(
        "frame_id", F.floor(F.col("node") / 2).cast("long").alias("cell"))


def _ways_out(forest: DataFrame, lost: DataFrame) -> DataFrame:
    """(frame_id, cell, saddle_id): over which saddle of the ``forest`` (frame_id, saddle_id, a, b) every lost cell reaches one that remains."""
    darts = cut(forest.select("frame_id", F.explode(F.array(
        F.struct((F.col("saddle_id") * 2).alias("id"), F.col("a").alias("from"), F.col("b").alias("to")),
        F.struct((F.col("saddle_id") * 2 + 1).alias("id"), F.col("b").alias("from"), F.col("a").alias("to")))).alias("d")).select("frame_id", "d.*"), "darts")
    back = F.col("id").bitwiseXOR(F.lit(1).cast("long"))
    turn = following(darts.select("frame_id", "from", "id"), ["frame_id", "from"], [F.col("id").asc()], "id", "after").select(
        "frame_id", back.alias("id"), "after")
    first = darts.groupBy("frame_id", F.col("from").alias("to")).agg(F.min("id").alias("first"))
    # the tour of a tree starts and ends at the cell that remains
    gone = lost.select("frame_id", F.col("cell").alias("to"), F.lit(True).alias("gone"))
    steps = darts.join(turn, ["frame_id", "id"]).join(first, ["frame_id", "to"]).join(gone, ["frame_id", "to"], "left")
    nxt = F.coalesce("after", F.when(F.col("gone"), F.col("first")))
    ranked = cut(rank_lists(cut(steps.select("frame_id", "id", nxt.alias("nxt")), "steps")), "ranked")
    twin = ranked.select("frame_id", back.alias("id"), F.col("to_end").alias("twin_to_end"))
    into = ranked.join(twin, ["frame_id", "id"]).filter("to_end > twin_to_end").join(darts, ["frame_id", "id"])
    return into.select("frame_id", F.col("to").alias("cell"), F.expr("id div 2").alias("saddle_id"))


def _new_pairs(fl: Flow, ways: DataFrame, tile: int) -> DataFrame:
    """(frame_id, fid, paired_hid): pairs of the faces on all turned paths.  ``ways`` (frame_id, cell, face, hid) say where they start."""
    vid, w = F.col("vid"), F.col("w").cast("long")
    step = F.when(F.col("fside") == 0, -w).when(F.col("fside") == 1, F.lit(1)).when(F.col("fside") == 2, w).when(F.col("fside") == 3, F.lit(-1)).otherwise(F.lit(0))
    faces = fl.table.filter("fside is not null").select("frame_id", "w", vid.alias("id"), (vid + step).cast("long").alias("nxt"), "fside", "x", "y", F.col("fref").alias("ref"))
    starts = ways.select("frame_id", F.col("cell").alias("path"), F.lit(0).cast("long").alias("pos"), F.col("face").alias("id")).join(
        faces.select("frame_id", "id", "ref"), ["frame_id", "id"]).withColumn("hops", F.lit(0).cast("long"))
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    found = entries(starts, faces.filter(edge).select("frame_id", "id", "ref", F.lit(0).cast("long").alias("hops")))
    width = fl.table.groupBy("frame_id").agg(F.first("w").alias("w"))
    walked = pieces(faces, found.select("frame_id", "id").join(width, "frame_id"), tile, {"id": "long", "w": "int", "nxt": "long", "fside": "int"})
    at, w = F.col("id"), F.col("w").cast("long")
    # the far side of the edge that the face before was paired with
    far = (F.when(F.col("fside") == 0, (at + 1) * 4 + LEFT).when(F.col("fside") == 1, (at + 1 + w) * 4 + UP)
           .when(F.col("fside") == 2, (at + w) * 4 + RIGHT).otherwise(at * 4 + DOWN))
    turned = walked.filter("fside >= 0").select("frame_id", F.col("nxt").alias("fid"), far.cast("long").alias("paired_hid"))
    return turned.unionByName(ways.select("frame_id", F.col("face").alias("fid"), F.col("hid").alias("paired_hid")))


def simplified_gradient(fl: Flow, saddles: DataFrame, tree: MergeTree, threshold: float, tile: int = TILE) -> Simplified:
    """Cancel the saddles with less than ``threshold`` significance.  ``saddles`` as in a network, with ``delta``; ``tree`` of the same flow."""
    one = lambda c: F.greatest(F.col(c), F.lit(OUTER).cast("long"))
    small = saddles.filter(F.col("delta") < threshold).withColumns({"cell_a": one("cell_a"), "cell_b": one("cell_b")}).filter("cell_a <> cell_b")
    small = cut(small.select("frame_id", "w", "saddle_id", "h", "x", "y", "a", "b", "cell_a", "cell_b"), "small")
    spark = small.sparkSession
    cells = small.select("frame_id", F.explode(F.array("cell_a", "cell_b")).alias("cell")).distinct()
    order = merge_tree_of(small, spark.createDataFrame([], "frame_id string, cell long, h double, n long"), cells, tile)
    forest = cut(small.join(order.saddles.filter("splits").select("frame_id", "saddle_id"), ["frame_id", "saddle_id"], "left_semi"), "forest")
    sides = lighter_sides(saddles.join(forest.select("frame_id", "saddle_id"), ["frame_id", "saddle_id"], "left_semi"), tree)
    light_a = F.coalesce("light_a", F.lit(False))
    light = forest.join(sides, ["frame_id", "saddle_id"], "left").select("frame_id", "saddle_id", F.when(light_a, F.col("cell_a")).otherwise(F.col("cell_b")).alias("cell"))
    lost = cut(_turned(order, light), "lost")
    ways = _ways_out(forest.select("frame_id", "saddle_id", F.col("cell_a").alias("a"), F.col("cell_b").alias("b")), lost)
    edges = G.saddle_edges(fl.table).select("frame_id", "saddle_id", "face_a", "face_b")
    beside = forest.select("frame_id", "saddle_id", F.col("b").alias("end"), "cell_a").join(edges, ["frame_id", "saddle_id"])
    other = (F.col("end") * 4 + F.when(F.col("saddle_id") % 4 == RIGHT, LEFT).otherwise(UP)).cast("long")
    is_a = F.col("cell") == F.col("cell_a")
    ways = cut(ways.join(beside, ["frame_id", "saddle_id"]).select("frame_id", "cell", F.when(is_a, F.col("face_a")).otherwise(F.col("face_b")).alias("face"),
                                                                 F.when(is_a, F.col("saddle_id")).otherwise(other).alias("hid")), "ways")
    new = _new_pairs(fl, ways, tile).withColumnRenamed("paired_hid", "_new")
    old = fl.table.filter("fside >= 0").select("frame_id", F.col("vid").alias("fid"), G.side_half_edge(F.col("fside"), F.col("vid"), F.col("w").cast("long")).alias("paired_hid"))
    pairs = old.join(new, ["frame_id", "fid"], "full").select("frame_id", "fid", F.coalesce("_new", "paired_hid").alias("paired_hid"))
    return Simplified(pairs, forest.select("frame_id", "saddle_id"), lost)
