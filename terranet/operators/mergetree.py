"""Queries on the merge tree.

The tree is a table (frame_id, kind, node_id, parent_id, h, x, y, volume_above):
leaves have kind 'maximum' or 'outer' and a cell id, inner nodes kind 'saddle'
and a saddle id; parents are always saddles.  Paths to the root can be as long
as the tree is large, so they are climbed with tables of 2^k-step ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.operators.significance import MergeTree
from terranet.plans.scratch import cut, is_empty
from terranet.plans.tours import intervals, tour, within

INF = float("inf")
NODE = ["frame_id", "kind", "node_id"]


def nodes(tree: MergeTree, maxima: DataFrame) -> DataFrame:
    """The tree as one table.  Leaves sit at their maximum (outer cells at +inf) and keep volume 0."""
    inner = tree.saddles.filter("splits").join(tree.parents, ["frame_id", "saddle_id"]).select(
        "frame_id", F.lit("saddle").alias("kind"), F.col("saddle_id").alias("node_id"), "parent_id", "h", "x", "y", "volume_above")
    top = maxima.select("frame_id", F.col("fid").alias("cell"), "h", "x", "y")
    leaves = tree.leaves.join(top, ["frame_id", "cell"], "left").select(
        "frame_id", F.when(F.col("cell") < 0, "outer").otherwise("maximum").alias("kind"), F.col("cell").alias("node_id"),
        "parent_id", F.coalesce("h", F.lit(INF)).alias("h"), F.coalesce("x", F.lit(-1.0)).alias("x"),
        F.coalesce("y", F.lit(-1.0)).alias("y"), F.lit(0.0).alias("volume_above"))
    return inner.unionByName(leaves)


def root(tree: DataFrame) -> DataFrame:
    return tree.filter("parent_id is null")


def order_children(tree: DataFrame, by: str = "x") -> DataFrame:
    """Rank of every node among its parent's (two) children."""
    w = Window.partitionBy("frame_id", "parent_id").orderBy(by, "x", "y")
    return tree.filter("parent_id is not null").withColumn("child_no", F.row_number().over(w))


def _key(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("h", "x", "y")])


def _ancestors(tree: DataFrame) -> list[DataFrame]:
    """Tables (frame_id, sid, anc, anc_key): the 2^k-th ancestor of every saddle that has one."""
    inner = tree.filter("kind = 'saddle'")
    place = inner.select("frame_id", F.col("node_id").alias("anc"), _key().alias("anc_key"))
    up = cut(inner.filter("parent_id is not null").select(
        "frame_id", F.col("node_id").alias("sid"), F.col("parent_id").alias("anc")).join(place, ["frame_id", "anc"]), "up")
    out = []
    while not is_empty(up):
        out.append(up)
        ahead = up.select("frame_id", F.col("sid").alias("anc"), F.col("anc").alias("_anc"), F.col("anc_key").alias("_key"))
        up = cut(up.join(ahead, ["frame_id", "anc"]).select(
            "frame_id", "sid", F.col("_anc").alias("anc"), F.col("_key").alias("anc_key")), "up")
    return out


def _climb(tree: DataFrame, queries: DataFrame, above: Column) -> DataFrame:
    """Climb from each query's node while the parent satisfies ``above`` (a condition on ``anc_key``).

    The condition must hold on a prefix of every root path.  Adds ``at`` (the
    saddle reached) or NULL if the node itself is the answer.
    """
    key = tree.select("frame_id", F.col("node_id").alias("anc"), _key().alias("anc_key")).where("kind = 'saddle'")
    first = queries.join(key.withColumnRenamed("anc", "parent_id"), ["frame_id", "parent_id"], "left")
    rows = first.withColumn("at", F.when(above, F.col("parent_id"))).drop("anc_key")
    for up in reversed(_ancestors(tree)):
        step = rows.join(up.withColumnRenamed("sid", "at"), ["frame_id", "at"], "left")
        rows = cut(step.withColumn("at", F.when(above, F.col("anc")).otherwise(F.col("at"))).drop("anc", "anc_key"), "climb")
    return rows


def ancestor_at(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """Highest ancestor still above a height, for queries (frame_id, kind, node_id, height).

    Climbs while the parent is strictly above; NULL kind and id if the node
    itself lies below the height.
    """
    known = queries.join(tree.select(*NODE, "parent_id", "h"), NODE)
    rows = _climb(tree, known, F.col("anc_key.h") > F.col("height"))
    below = F.col("h") < F.col("height")
    return rows.select(*NODE, "height",
                       F.when(~below, F.when(F.col("at").isNotNull(), "saddle").otherwise(F.col("kind"))).alias("ancestor_kind"),
                       F.when(~below, F.coalesce("at", "node_id")).alias("ancestor_id"))


def _node_id(kind: Column, node: Column) -> Column:
    """One id for saddles and cells."""
    return node * 2 + F.when(kind == "saddle", 0).otherwise(1)


def tree_intervals(tree: DataFrame) -> DataFrame:
    """(frame_id, node, tail, low, high): every subtree of the merge tree as an interval of its Euler tour."""
    rows = tree.select("frame_id", _node_id(F.col("kind"), F.col("node_id")).alias("id"), (F.col("parent_id") * 2).alias("parent"))
    return intervals(tour(cut(rows, "tree")))


def subtree_mask(tree: DataFrame, cell_faces: DataFrame, frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Raster cells (frame_id, mask_id, x, y) of the subtrees of ``wanted`` (frame_id, mask_id, kind, node_id).

    A leaf belongs to the wanted nodes whose interval of the Euler tour holds its place.
    """
    places = cut(tree_intervals(tree), "intervals")
    ranges = wanted.select("frame_id", "mask_id", _node_id(F.col("kind"), F.col("node_id")).alias("node")).join(places, ["frame_id", "node"]).select(
        "frame_id", "mask_id", "tail", "low", "high")
    leaves = places.filter("node % 2 <> 0").select("frame_id", "tail", F.floor(F.col("node") / 2).cast("long").alias("cell"), F.col("high").alias("place"))
    inside = within(leaves, "place", ranges, "low", "high", ["frame_id", "tail"])
    width = frames.select("frame_id", "width")
    return inside.select("frame_id", "mask_id", "cell").join(cell_faces, ["frame_id", "cell"]).join(width, "frame_id").select(
        "frame_id", "mask_id", F.expr("cast(fid % width as int)").alias("x"), F.expr("cast(fid div width as int)").alias("y"))


def pruned_tree(tree: DataFrame, delta: float) -> DataFrame:
    """Nodes left when every child subtree whose node has less than ``delta`` volume is cut off."""
    ok = (F.col("volume_above") >= delta) | F.col("parent_id").isNull()
    state = cut(tree.filter("kind = 'saddle'").select(
        "frame_id", "node_id", F.col("parent_id").alias("ptr"), ok.alias("ok")), "prune")
    while not is_empty(state.filter("ptr is not null")):
        ahead = state.select("frame_id", F.col("node_id").alias("_key"), F.col("ptr").alias("_ptr"), F.col("ok").alias("_ok"))
        going = F.col("ptr").isNotNull()
        # nodes that reached the root keep keys of their own instead of NULL
        keyed = state.withColumn("_key", F.coalesce("ptr", -1 - F.col("node_id")))
        state = cut(keyed.join(ahead, ["frame_id", "_key"], "left").select(
            "frame_id", "node_id", F.when(going, F.col("_ptr")).alias("ptr"),
            F.when(going, F.col("ok") & F.col("_ok")).otherwise(F.col("ok")).alias("ok")), "prune")
    kept = state.filter("ok").select("frame_id", "node_id")
    inner = tree.filter("kind = 'saddle'").join(kept, ["frame_id", "node_id"], "left_semi")
    parent = kept.withColumnRenamed("node_id", "parent_id")
    alone = tree.filter("kind <> 'saddle' and parent_id is null")
    leaves = tree.filter("kind <> 'saddle'").filter(F.col("volume_above") >= delta).join(
        parent, ["frame_id", "parent_id"], "left_semi").select(*tree.columns)
    return inner.select(*tree.columns).unionByName(leaves).unionByName(alone)
