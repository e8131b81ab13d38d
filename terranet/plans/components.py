"""Connected components: labels spread by hooking and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terranet.plans.scratch import cut, is_empty


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (frame_id, a, b) of any ordered id type -> (frame_id, id, component = smallest id).

    Every round each node adopts the smallest label around it, labels follow
    their own label, and edges inside one component disappear.  Both
    aggregations combine on the map side, so hub nodes cost no more than others.
    """
    todo = cut(edges.select("frame_id", "a", "b").filter("a <> b"), "edges")
    labels = cut(edges.select("frame_id", F.explode(F.array("a", "b")).alias("id")).distinct()
                 .withColumn("component", F.col("id")), "labels")
    while not is_empty(todo):
        both = todo.select("frame_id", "a", "b").unionByName(todo.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("frame_id", "a").agg(F.min("b").alias("low")).filter("low < a")
        hook = cut(hook.select("frame_id", F.col("a").alias("id"), F.col("low").alias("to")), "hooks")
        while True:
            ahead = hook.select("frame_id", F.col("id").alias("to"), F.col("to").alias("_to"))
            jumped = cut(hook.join(ahead, ["frame_id", "to"], "left").select(
                "frame_id", "id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "hooks")
            hook = jumped.select("frame_id", "id", "to")
            if is_empty(jumped.filter("moved")):
                break
        def moved(rows, column):
            to = hook.select("frame_id", F.col("id").alias(column), F.col("to").alias("_to"))
            return rows.join(to, ["frame_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
        labels = cut(moved(labels, "component"), "labels")
        todo = cut(moved(moved(todo, "a"), "b").filter("a <> b").select("frame_id", "a", "b").distinct(), "edges")
    return labels


def _label_tile(rows: pa.Table) -> pa.Table:
    """Label the 4-connected groups of one tile by their smallest (x, y)."""
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    x0, y0 = xs.min(), ys.min()
    place = np.full((xs.max() - x0 + 1, ys.max() - y0 + 1), -1, dtype=np.int64)
    place[xs - x0, ys - y0] = np.arange(len(xs))
    pairs = np.concatenate([
        np.stack([place[1:, :].ravel(), place[:-1, :].ravel()], 1), np.stack([place[:, 1:].ravel(), place[:, :-1].ravel()], 1)])
    pairs = pairs[(pairs >= 0).all(axis=1)]
    label = np.arange(len(xs))
    while True:
        la, lb = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(label[label], label):
            label = label[label]
        pairs = pairs[apart]
    out = np.empty(len(x), dtype=np.int64)
    out[order] = label
    return rows.select(["frame_id", "x", "y"]).append_column("rx", pa.array(xs[out], type=pa.int32())).append_column(
        "ry", pa.array(ys[out], type=pa.int32()))


def grid_components(points: DataFrame, tile: int) -> DataFrame:
    """4-connected groups of grid points (frame_id, x, y), labelled by their smallest (x, y).

    Tiles label their own points; only the contacts between neighbouring tiles
    take part in the distributed rounds.
    """
    rows = points.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    local = cut(rows.groupBy("frame_id", "tx", "ty").applyInArrow(
        _label_tile, "frame_id string, x int, y int, rx int, ry int"), "local")
    local = local.withColumn("r", F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"))).drop("rx", "ry")
    meets = None
    for axis, other in (("x", "y"), ("y", "x")):
        first = local.filter(F.col(axis) % tile == 0).select(
            "frame_id", (F.col(axis) - 1).alias(axis), other, F.col("r").alias("b"))
        last = local.filter(F.col(axis) % tile == tile - 1).withColumnRenamed("r", "a")
        contact = last.join(first, ["frame_id", axis, other]).select("frame_id", "a", "b").distinct()
        meets = contact if meets is None else meets.unionByName(contact)
    joined = components(meets).select("frame_id", F.col("id").alias("r"), "component")
    return local.join(joined, ["frame_id", "r"], "left").select(
        "frame_id", "x", "y", F.coalesce("component", "r").alias("region"))


def bfs_distance(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Hops from the nearest source along directed ``edges`` (frame_id, a, b), for all that can be reached.

    One join per hop with the newest frontier only.  With ``max_hops`` nodes farther away are left out.
    """
    reached = cut(sources.select("frame_id", "id").distinct().withColumn("hops", F.lit(0)), "bfs")
    frontier, hop = reached, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.select("frame_id", F.col("id").alias("a")).join(edges, ["frame_id", "a"]).select(
            "frame_id", F.col("b").alias("id")).distinct()
        frontier = cut(step.join(reached, ["frame_id", "id"], "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        if is_empty(frontier):
            break
        reached = reached.unionByName(frontier)
    return reached
