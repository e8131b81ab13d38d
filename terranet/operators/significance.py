"""Merge tree of the Morse cells and the sand volume (significance) of saddles.

Saddles are swept from high to low; the two components beside a saddle merge,
and its significance is the smaller of their volumes above the saddle.  The sweep
is never run.  From the contraction of the cell graph (``plans.contraction``)
every group (v, b) that hooks over its highest edge m owns a *chain*: the saddles
inside the group that are higher than m, in order.  A saddle, or a corner of a
cell, belongs to the first chain on its cell's path whose m is lower.  Then

* the parent of a chain's saddle is the next one of the chain, and of the last
  one the chain's own m, because a hooking group is always a whole component when
  its m comes up;
* the component on the other side of a saddle is what the chain has gathered so
  far: a prefix sum of (sum of heights, count) over the chain.

All volumes are additive pairs, V(h) = (sum - n*h)/4; outer cells only carry a
counter that makes a volume infinite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from terranet.operators.flow import Flow
from terranet.operators.stencil import TILE
from terranet.plans.contraction import contract, group_paths
from terranet.plans.ordered import following, sums_before
from terranet.plans.scratch import cut

INF = float("inf")
CHAIN = ["frame_id", "cv", "cb"]


def _first(path: Column, lower) -> Column:
    return F.element_at(F.filter(path, lower), 1)


def _point(p: Column) -> Column:
    return F.struct(p["h"].alias("h"), p["x"].alias("x"), p["y"].alias("y"))


def _volume(total: Column, n: Column, inf: Column, h: Column) -> Column:
    return F.when(inf > 0, F.lit(INF)).otherwise(0.25 * (total - n * h))


def _with_path(rows: DataFrame, paths: DataFrame, cell: str) -> DataFrame:
    """Join each row with the path of its cell; the rows of a hot cell may be split by AQE."""
    own = paths.filter("b = 0").select("frame_id", F.col("v").alias(cell), "path")
    return rows.join(own, ["frame_id", cell], "left")


@dataclass
class MergeTree:
    """Everything the volume sweep yields, materialised.

    * ``saddles``: (frame_id, saddle_id, h, x, y, splits, delta, volume_above, group_v, group_b,
      group_volume, other_volume) with +inf for unbounded volumes; the last four only for splitting
      saddles: one of the two components is the group (v, b), and the volumes of it and of the other
    * ``parents``: (frame_id, saddle_id, parent_id) of the splitting saddles
    * ``leaves``: (frame_id, cell, parent_id)
    """

    saddles: DataFrame
    parents: DataFrame
    leaves: DataFrame
    corners: DataFrame
    paths: DataFrame


def merge_tree_of(saddles: DataFrame, corners: DataFrame, cells: DataFrame, tile: int = TILE) -> MergeTree:
    """Sweep ``saddles`` (frame_id, w, saddle_id, h, x, y, cell_a, cell_b), materialised.

    ``corners`` (frame_id, cell, h, n) hold the bounded cells' sand, ``cells``
    (frame_id, cell) lists every cell.
    """
    edges = saddles.filter("cell_a <> cell_b").select(
        "frame_id", "w", F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), "h", "x", "y",
        F.col("saddle_id").alias("sid"))
    hooks = contract(cut(edges, "edges"), tile)
    paths = group_paths(hooks)

    # --- which chain every corner, outer cell and saddle belongs to
    sand = _with_path(corners, paths, "cell")
    at = _first(F.col("path"), lambda p: p["h"] <= F.col("h"))
    sand = sand.select("frame_id", F.coalesce(at["v"], "cell").alias("cv"), F.coalesce(at["b"], F.lit(0)).alias("cb"),
                       "h", "n").groupBy(*CHAIN, "h").agg(F.sum("n").alias("n"))
    sand = sand.select(*CHAIN, "h", (F.col("h") * F.col("n")).alias("total"), "n", F.lit(0).cast("long").alias("inf"))
    outer = _with_path(cells.filter("cell < 0"), paths, "cell").select(
        "frame_id", F.coalesce(F.col("path")[0]["v"], "cell").alias("cv"),
        F.coalesce(F.col("path")[0]["b"], F.lit(0)).alias("cb"), F.lit(INF).alias("h"),
        F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("inf"))
    sand = cut(sand.unionByName(outer), "sand")

    # --- total content of every chain: a chain feeds the chains its lowest edges end up in
    chain_paths = paths.select("frame_id", F.col("v").alias("cv"), F.col("b").alias("cb"), "path")
    own = sand.groupBy(*CHAIN).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("inf").alias("inf"))
    fed = own.join(chain_paths, CHAIN).select(
        "frame_id", "total", "n", "inf", F.explode(F.filter("path", lambda p: p["sid"].isNotNull())).alias("p"))
    content = fed.groupBy("frame_id", F.col("p.v").alias("v"), F.col("p.b").alias("b")).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("inf").alias("inf"))

    # --- splitting saddles: one or two hooked groups end at each
    w = F.struct("h", "x", "y")
    rest = F.slice("path", 2, F.size("path"))
    zero = F.lit(0)
    own_edge = F.col("path")[0]  # a group that hooks is the first on its own path
    hooked = paths.filter((own_edge["v"] == F.col("v")) & (own_edge["b"] == F.col("b"))).select(
        "frame_id", "v", "b", "path", *[own_edge[c].alias(c) for c in ("sid", "h", "x", "y")]).withColumn(
        "at", _first(rest, lambda p: _point(p) < w)).drop("path").join(content, ["frame_id", "v", "b"], "left")
    side = _volume(F.coalesce("total", zero), F.coalesce("n", zero), F.coalesce("inf", zero), F.col("h"))
    merged = hooked.withColumn("side", F.struct(side.alias("volume"), "v", "b")).groupBy("frame_id", "sid").agg(
        F.first("at").alias("at"), F.first("h").alias("h"), F.first("x").alias("x"), F.first("y").alias("y"),
        F.min("side").alias("low"), F.max("side").alias("high"), F.count("*").alias("sides"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), zero).alias("n"),
        F.coalesce(F.sum("inf"), zero).alias("inf"))
    merged = cut(merged.select("frame_id", F.col("at.v").alias("cv"), F.col("at.b").alias("cb"), "sid", "h", "x", "y",
                               "sides", F.col("low.volume").alias("low"), F.col("high.volume").alias("high"),
                               F.col("low.v").alias("group_v"), F.col("low.b").alias("group_b"), "total", "n", "inf"), "splits")

    # --- other saddles only read what their component holds at their height
    splitting = merged.select("frame_id", F.col("sid").alias("saddle_id"))
    inner = _with_path(saddles.join(splitting, ["frame_id", "saddle_id"], "left_anti").withColumnRenamed(
        "cell_a", "cell"), paths, "cell")
    at = _first(F.col("path"), lambda p: _point(p) < w)
    inner = inner.select("frame_id", F.coalesce(at["v"], "cell").alias("cv"), F.coalesce(at["b"], zero).alias("cb"),
                         F.col("saddle_id").alias("sid"), "h", "x", "y")

    none = lambda t: F.lit(None).cast(t)
    events = cut(
        sand.select(*CHAIN, none("long").alias("sid"), "h", F.lit(INF).alias("x"), F.lit(INF).alias("y"),
                    zero.cast("long").alias("sides"), none("double").alias("low"), none("double").alias("high"),
                    none("long").alias("group_v"), none("int").alias("group_b"), "total", "n", "inf")
        .unionByName(merged)
        .unionByName(inner.select(*CHAIN, "sid", "h", "x", "y", zero.cast("long").alias("sides"),
                                  none("double").alias("low"), none("double").alias("high"),
                                  none("long").alias("group_v"), none("int").alias("group_b"), F.lit(0.0).alias("total"), zero.cast("long").alias("n"),
                                  zero.cast("long").alias("inf"))), "events")
    down = [F.col("h").desc(), F.col("x").desc(), F.col("y").desc()]
    swept = sums_before(events, CHAIN, down, ["total", "n", "inf"]).filter("sid is not null")
    gathered = _volume(F.col("total_before"), F.col("n_before"), F.col("inf_before"), F.col("h"))
    sides = F.col("sides")
    lower = F.when(sides == 2, F.col("low")).when(sides == 1, F.least("low", gathered)).otherwise(gathered)
    upper = F.when(sides == 2, F.col("high")).when(sides == 1, F.greatest("low", gathered)).otherwise(gathered)
    result = cut(swept.select(
        "frame_id", F.col("sid").alias("saddle_id"), "h", "x", "y", (sides > 0).alias("splits"),
        lower.alias("delta"), F.when(sides > 0, lower + upper).otherwise(gathered).alias("volume_above"),
        "group_v", "group_b", F.when(sides == 2, F.col("high")).when(sides == 1, gathered).alias("other_volume"),
        F.when(sides > 0, F.col("low")).alias("group_volume")), "delta")

    # --- tree
    ordered = following(merged.select(*CHAIN, "sid", "h", "x", "y"), CHAIN, down, "sid", "next_sid")
    ends = hooks.filter("sid is not null").select(
        "frame_id", F.col("v").alias("cv"), F.col("b").alias("cb"), F.col("sid").alias("end_sid"))
    parents = ordered.join(ends, CHAIN, "left").select(
        "frame_id", F.col("sid").alias("saddle_id"), F.coalesce("next_sid", "end_sid").alias("parent_id"))
    leaf_edges = edges.select("frame_id", F.explode(F.array("a", "b")).alias("cell"),
                              F.struct("h", "x", "y", "sid").alias("m")).groupBy("frame_id", "cell").agg(
        F.max("m").alias("m"))
    leaves = cells.join(leaf_edges, ["frame_id", "cell"], "left").select(
        "frame_id", "cell", F.col("m.sid").alias("parent_id"))
    return MergeTree(result, parents, leaves, corners, paths)


def merge_tree(fl: Flow, saddles: DataFrame, tile: int = TILE) -> MergeTree:
    """Merge tree of a region.  ``saddles`` as from ``Flow.saddles``, materialised."""
    bounded = fl.maxima().select("frame_id", F.col("fid").alias("cell"))
    beyond = saddles.select("frame_id", F.explode(F.array("cell_a", "cell_b")).alias("cell")).filter(
        "cell < 0").distinct()
    return merge_tree_of(saddles, fl.corners(), bounded.unionByName(beyond), tile)
