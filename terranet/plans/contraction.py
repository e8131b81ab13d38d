"""Hierarchical contraction of the cell graph along highest edges (Boruvka).

Every round each group of cells hooks onto its neighbour over its highest edge.
The hooked edges form the maximum spanning forest, and the sequence of groups a
cell belongs to is enough to recover the whole merge tree: see
``operators.significance``.

A group is named (v, b): a cell id and the round it was born in (0 = the cell
itself).  Tiles contract what they can decide alone first, so the distributed
rounds start from the edges that cross tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terranet.operators.stencil import TILE
from terranet.plans.scratch import cut, is_empty, scratch_path

HUB_EDGES = 20_000   # cells with more edges than this take part in the distributed rounds only
_LATER = 1000        # birth numbers of the distributed rounds start here

_LOCAL = "kind int, frame_id string, v long, b int, h double, x double, y double, sid long, nv long, nb int"
HOOK, PASS, LABEL = 0, 1, 2


def _contract_tile(edges: pa.Table) -> pa.Table:
    """Contract the cells of one tile while their highest edge stays in the tile.

    Column ``a`` is a cell of this tile; ``b`` is one too where ``both`` is set.
    """
    col = lambda name: edges[name].to_numpy()
    a, b, both = col("a"), col("b"), col("both")
    h, x, y, sid = col("h"), col("x"), col("y"), col("sid")
    cells = np.unique(np.concatenate([a, b[both]]))
    ia = np.searchsorted(cells, a)
    ib = np.where(both, np.searchsorted(cells, np.where(both, b, cells[0])), -1)
    order = np.lexsort((y, x, h))
    rank = np.empty(len(a), dtype=np.int64)
    rank[order] = np.arange(len(a))
    label = np.arange(len(cells))          # cell -> index of its group's root cell
    born = np.zeros(len(cells), dtype=np.int32)
    out = []
    level = 0
    while True:
        ga, gb = label[ia], np.where(both, label[ib], -1)
        alive = ga != gb
        best = np.full(len(cells), -1, dtype=np.int64)
        np.maximum.at(best, ga[alive], rank[alive])
        np.maximum.at(best, gb[alive & both], rank[alive & both])
        edge = order[np.maximum(best, 0)]
        groups = np.arange(len(cells))
        hooking = (best >= 0) & both[edge]
        if not hooking.any():
            break
        level += 1
        other = np.where(ga[edge] == groups, gb[edge], ga[edge])
        ptr = np.where(hooking, other, groups)
        ptr = np.where((ptr[ptr] == groups) & (groups < ptr), groups, ptr)
        while not np.array_equal(ptr[ptr], ptr):
            ptr = ptr[ptr]
        g = groups[hooking]
        e = edge[hooking]
        out.append((HOOK, cells[g], born[g], h[e], x[e], y[e], sid[e], cells[ptr[g]], level))
        still = np.unique(ptr[g])
        still = still[~hooking[still]]
        nan = np.full(len(still), np.nan)
        out.append((PASS, cells[still], born[still], nan, nan, nan, np.full(len(still), -1), cells[still], level))
        born[np.unique(ptr[g])] = level
        label = ptr[label]
    zero = np.zeros(len(cells))
    out.append((LABEL, cells, zero.astype(np.int32), zero, zero, zero, zero.astype(np.int64),
                cells[label], born[label]))
    frame = edges["frame_id"][0].as_py()
    n = [len(o[1]) for o in out]
    stack = lambda k, dtype: pa.array(np.concatenate([
        np.broadcast_to(np.asarray(o[k], dtype=dtype), (m,)) for o, m in zip(out, n)]))
    return pa.table({
        "kind": stack(0, np.int32), "frame_id": pa.array([frame] * sum(n)), "v": stack(1, np.int64),
        "b": stack(2, np.int32), "h": stack(3, np.float64), "x": stack(4, np.float64), "y": stack(5, np.float64),
        "sid": stack(6, np.int64), "nv": stack(7, np.int64), "nb": stack(8, np.int32)})


def _tile_of(cell: str, axis: str, tile: int) -> Column:
    pos = f"{cell} % w" if axis == "x" else f"{cell} div w"
    return F.when(F.col(cell) >= 0, F.expr(f"cast(({pos}) div {tile} as int)"))


def _local_phase(edges: DataFrame, tile: int) -> DataFrame:
    ends = edges.select("frame_id", F.explode(F.array("a", "b")).alias("cell")).filter("cell >= 0")
    hubs = cut(ends.groupBy("frame_id", "cell").count().filter(F.col("count") > HUB_EDGES)
               .select("frame_id", "cell"), "hubs")
    rows = edges.withColumns({"atx": _tile_of("a", "x", tile), "aty": _tile_of("a", "y", tile),
                              "btx": _tile_of("b", "x", tile), "bty": _tile_of("b", "y", tile)})
    if not is_empty(hubs):
        for end in "ab":
            found = hubs.select("frame_id", F.col("cell").alias(end), F.lit(True).alias("hub"))
            rows = rows.join(found, ["frame_id", end], "left")
            rows = rows.withColumns({f"{end}tx": F.when(F.col("hub").isNull(), F.col(f"{end}tx")),
                                     f"{end}ty": F.when(F.col("hub").isNull(), F.col(f"{end}ty"))}).drop("hub")
    same = F.coalesce((F.col("atx") == F.col("btx")) & (F.col("aty") == F.col("bty")), F.lit(False))
    seen = lambda p, q: F.when(F.col(f"{p}tx").isNotNull(), F.struct(
        F.col(f"{p}tx").alias("tx"), F.col(f"{p}ty").alias("ty"), F.col(p).alias("a"), F.col(q).alias("b"),
        same.alias("both")))
    copies = rows.select("frame_id", "h", "x", "y", "sid", F.explode(F.array_compact(F.array(
        seen("a", "b"), F.when(~same, seen("b", "a"))))).alias("c")).select("frame_id", "c.*", "h", "x", "y", "sid")
    return cut(copies.groupBy("frame_id", "tx", "ty").applyInArrow(_contract_tile, _LOCAL), "local")


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Move edges to their new groups, drop inner ones, keep the highest of parallel ones."""
    for end in "ab":
        to = labels.select("frame_id", F.col("v").alias(end), F.col("b").alias(f"{end}b"),
                           F.col("nv").alias("_nv"), F.col("nb").alias("_nb"))
        edges = edges.join(to, ["frame_id", end, f"{end}b"], "left").withColumns(
            {end: F.coalesce("_nv", end), f"{end}b": F.coalesce("_nb", f"{end}b")}).drop("_nv", "_nb")
    ends = F.sort_array(F.array(F.struct(F.col("a").alias("v"), F.col("ab").alias("b")),
                                F.struct(F.col("b").alias("v"), F.col("bb").alias("b"))))
    best = edges.filter("a <> b or ab <> bb").withColumn("e", ends).groupBy("frame_id", "e").agg(
        F.max(F.struct("h", "x", "y", "sid")).alias("m"))
    return best.select("frame_id", F.col("e")[0]["v"].alias("a"), F.col("e")[0]["b"].alias("ab"),
                       F.col("e")[1]["v"].alias("b"), F.col("e")[1]["b"].alias("bb"), "m.*")


def _round(edges: DataFrame, born: int) -> DataFrame:
    """Hooks of one distributed round: (v, b) over its highest edge into group (nv, born)."""
    def seen_from(p, q):
        return F.struct(F.col(p).alias("v"), F.col(f"{p}b").alias("b"),
                        F.struct("h", "x", "y", "sid", F.col(q).alias("ov"), F.col(f"{q}b").alias("ob")).alias("m"))
    picks = edges.select("frame_id", F.explode(F.array(seen_from("a", "b"), seen_from("b", "a"))).alias("s")).groupBy(
        "frame_id", "s.v", "s.b").agg(F.max("s.m").alias("m")).select("frame_id", "v", "b", "m.*")
    picks = cut(picks, "picks")
    partner = picks.select("frame_id", F.col("v").alias("ov"), F.col("b").alias("ob"), F.col("sid").alias("_sid"))
    # of two groups that chose the same edge, the smaller stays as root
    mutual = (F.col("_sid") == F.col("sid")) & (F.struct("v", "b") < F.struct("ov", "ob"))
    ptr = cut(picks.join(partner, ["frame_id", "ov", "ob"]).select(
        "frame_id", "v", "b", F.when(mutual, F.col("v")).otherwise(F.col("ov")).alias("nv"),
        F.when(mutual, F.col("b")).otherwise(F.col("ob")).alias("nb")), "ptr")
    while True:
        onward = ptr.select("frame_id", F.col("v").alias("nv"), F.col("b").alias("nb"),
                            F.col("nv").alias("_nv"), F.col("nb").alias("_nb"))
        ptr = cut(ptr.join(onward, ["frame_id", "nv", "nb"]).select(
            "frame_id", "v", "b", F.col("_nv").alias("nv"), F.col("_nb").alias("nb"),
            ((F.col("_nv") != F.col("nv")) | (F.col("_nb") != F.col("nb"))).alias("moved")), "ptr")
        if is_empty(ptr.filter("moved")):
            break
    return cut(picks.join(ptr.select("frame_id", "v", "b", "nv"), ["frame_id", "v", "b"]).select(
        "frame_id", "v", "b", "h", "x", "y", "sid", "nv", F.lit(born).alias("nb")), "hooks")


def contract(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """All hooks of the cell graph.

    ``edges`` (frame_id, w, a, b, h, x, y, sid) connect cells a <> b and must be
    materialised.  Returns hooks (frame_id, v, b, h, x, y, sid, nv, nb); a NULL
    ``sid`` marks a group that was joined by others without hooking itself.
    """
    local = _local_phase(edges, tile)
    columns = ["frame_id", "v", "b", "h", "x", "y", "sid", "nv", "nb"]
    found = [local.filter(F.col("kind") != LABEL).withColumn(
        "sid", F.when(F.col("kind") == HOOK, F.col("sid"))).select(*columns)]
    labels = local.filter(F.col("kind") == LABEL).select("frame_id", "v", "b", "nv", "nb")
    start = edges.select("frame_id", "a", F.lit(0).alias("ab"), "b", F.lit(0).alias("bb"), "h", "x", "y", "sid")
    rest = cut(_relabel(start, labels), "edges")
    born = _LATER
    while not is_empty(rest):
        born += 1
        hooks = _round(rest, born)
        found.append(hooks)
        rest = cut(_relabel(rest, hooks), "edges")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out, "hooks")


_ELEMENT = "array<struct<v:long,b:int,h:double,x:double,y:double,sid:long>>"


def group_paths(hooks: DataFrame) -> DataFrame:
    """For every group the groups it later becomes part of, with the edge each hooked over.

    (frame_id, v, b, path): the path starts at the group itself and closes with
    the final group, which has h = -inf.  Groups whose edge is higher than one
    before them on the path are left out, since whatever is above such an edge is
    above the earlier one too; so edges fall along a path, which keeps it short.
    Groups are taken by the birth of the group they become part of, latest first, and each is
    written once, next to the finished path of that group.  Until then it is one narrow row, so
    the many groups that become part of the same one do not bring their paths to one task.
    There are as many rounds as births, which is logarithmic in the number of cells.
    """
    spark = hooks.sparkSession
    here = F.struct("v", "b", "h", "x", "y", "sid")
    low = F.lit(float("-inf"))
    end = F.array(F.struct(F.col("nv").alias("v"), F.col("nb").alias("b"), low.alias("h"), low.alias("x"),
                           low.alias("y"), F.lit(None).cast("long").alias("sid"))).cast(_ELEMENT)
    edge = F.struct("h", "x", "y")
    lower = F.filter("_path", lambda p: F.struct(p["h"].alias("h"), p["x"].alias("x"), p["y"].alias("y")) < edge)
    path = F.when(F.col("sid").isNull(), F.coalesce("_path", end)).otherwise(
        F.concat(F.array(here).cast(_ELEMENT), F.coalesce(lower, end)))
    schema = f"frame_id string, v long, b int, path {_ELEMENT}"
    folder, written = scratch_path(spark, "paths"), []
    rows = spark.createDataFrame([], schema)
    for born in sorted((r.nb for r in hooks.select("nb").distinct().collect()), reverse=True):
        into = rows.filter(F.col("b") == born).select("frame_id", F.col("v").alias("nv"), F.col("path").alias("_path"))
        found = hooks.filter(F.col("nb") == born).join(into, ["frame_id", "nv"], "left")
        written.append(f"{folder}/{born}")
        found.select("frame_id", "v", "b", path.alias("path")).write.parquet(written[-1])
        rows = spark.read.schema(schema).parquet(*written)
    return rows
