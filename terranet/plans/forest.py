"""Following pointers to their end, for forests laid out on raster tiles.

Chains are first followed inside each tile by a small Arrow kernel (the tile
bounds its memory).  What remains are pointers that leave their tile; they point
at tile-edge nodes only, so the table that pointer jumping works on is the tile
perimeters, not the raster.  The number of rounds is logarithmic in the number
of tiles a chain crosses.

A *ref* is a LONG that names where a pointer has got to so far: negative = left
the mesh (final), ``2*id`` = ended at node ``id``, ``2*id+1`` = waits at node
``id`` of another tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from terranet.plans.scratch import cut, is_empty


def follow_local(ids: np.ndarray, nxt: np.ndarray, wanted: list[np.ndarray] = ()):
    """Follow ``nxt`` among ``ids`` as far as it stays inside; nxt == id ends a chain.

    Returns (ref, hops) for ``ids`` and one ref array per array of ``wanted`` ids.
    """
    order = np.argsort(ids, kind="stable")
    keys = ids[order]

    def position(values):
        if not len(keys):
            return np.full(len(values), -1)
        pos = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[pos] == values, order[pos], -1)

    ends = nxt == ids
    target = position(nxt)
    inside = (target >= 0) & ~ends
    ptr = np.where(inside, target, np.arange(len(ids)))
    hops = inside.astype(np.int64)
    while True:
        further = ptr[ptr]
        if np.array_equal(further, ptr):
            break
        hops = hops + hops[ptr]
        ptr = further
    last = nxt[ptr]
    ref = np.where(ends[ptr], 2 * ids[ptr], np.where(last < 0, last, 2 * last + 1))
    hops = hops + ~ends[ptr]
    looked_up = []
    for values in wanted:
        pos = position(values)
        known = ref[pos] if len(keys) else pos
        looked_up.append(np.where(values < 0, values, np.where(pos >= 0, known, 2 * values + 1)))
    return ref, hops, looked_up


def waits(ref: Column | str) -> Column:
    col = F.col(ref) if isinstance(ref, str) else ref
    return (col >= 0) & (col % 2 == 1)


def settle_exits(border: DataFrame) -> DataFrame:
    """Pointer-jump the tile-edge nodes (frame_id, id, ref, hops) until none waits."""
    table = cut(border.select("frame_id", "id", "ref", F.col("hops").cast("long").alias("hops")), "exits")
    while not is_empty(table.filter(waits("ref"))):
        table = cut(jump(table, table, "ref", "hops"), "exits")
    return table


def jump(rows: DataFrame, exits: DataFrame, ref: str, hops: str | None = None) -> DataFrame:
    """Replace waiting refs by what the exits table knows about their node.

    Settled rows get a key of their own so they spread over all partitions
    instead of meeting on NULL; a small exits table is broadcast by its file size.
    """
    key = F.when(waits(ref), F.expr(f"{ref} div 2")).otherwise(-1 - F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 62)))
    far = exits.select(F.col("frame_id"), F.col("id").alias("_key"), F.col("ref").alias("_ref"),
                       F.col("hops").alias("_hops"))
    out = rows.withColumn("_key", key).join(far, ["frame_id", "_key"], "left")
    out = out.withColumn(ref, F.coalesce("_ref", ref))
    if hops:
        out = out.withColumn(hops, F.col(hops) + F.coalesce("_hops", F.lit(0)))
    return out.select(*rows.columns)


def settled(ref: Column | str) -> Column:
    """Node id (or negative outside code) of a ref that no longer waits."""
    col = F.col(ref) if isinstance(ref, str) else ref
    return F.when(col < 0, col).otherwise(F.floor(col / 2)).cast("long")
