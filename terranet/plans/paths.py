"""Points of paths in pointer forests that are laid out on raster tiles.

A path is a row of pieces, one for each tile it crosses.  The places where paths start
or enter a tile follow from the pointers of tile-edge nodes, which tiles have already
followed to their own edge; doubling these pointers finds all of them in rounds that are
logarithmic in the tiles crossed.  Each tile then walks the pieces that start in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from terranet.plans.forest import waits
from terranet.plans.scratch import cut, is_empty


def entries(starts: DataFrame, exits: DataFrame) -> DataFrame:
    """Starts of all pieces (frame_id, path, pos, id), materialised.

    ``starts`` (frame_id, path, pos, id, ref, hops) say where every path starts and where
    it leaves its tile; ``exits`` (frame_id, id, ref, hops) say it for tile-edge nodes.
    """
    onward = lambda rows: rows.filter(waits("ref")).select(
        "frame_id", "path", (F.col("pos") + F.col("hops")).alias("pos"), F.expr("ref div 2").alias("id"))
    starts = cut(starts, "starts")
    heads = starts.select("frame_id", "path", "pos", "id")
    found = cut(onward(starts), "entries")
    if is_empty(found):
        return heads
    jumps = cut(exits.filter(waits("ref")).select("frame_id", "id", F.expr("ref div 2").alias("to"), F.col("hops").cast("long").alias("hops")), "jumps")
    while True:
        # ``found`` holds the first 2^k entries of every path, ``jumps`` lead 2^k entries on
        new = cut(found.join(jumps, ["frame_id", "id"]).select("frame_id", "path", (F.col("pos") + F.col("hops")).alias("pos"), F.col("to").alias("id")), "entries")
        if is_empty(new):
            return heads.unionByName(found)
        found = cut(found.unionByName(new), "entries")
        ahead = jumps.select("frame_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        jumps = cut(jumps.join(ahead, ["frame_id", "to"]).select("frame_id", "id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops")), "jumps")


def walk(ids: np.ndarray, nxt: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start number, step, position in ``ids``) of every place that paths from ``starts`` meet before they end or leave; nxt == id ends."""
    order = np.argsort(ids, kind="stable")
    keys = ids[order]

    def position(values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, order[at], -1)

    ahead = np.where(nxt == ids, -1, position(nxt))
    which, at, step, out = np.arange(len(starts)), position(starts), 0, []
    while len(at):
        out.append((which, np.full(len(which), step), at))
        on = ahead[at] >= 0
        which, at, step = which[on], ahead[at[on]], step + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _walk_tile(columns: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        if not len(starts) or not len(rows):
            return schema.empty_table()
        first = starts["id"].to_numpy()
        which, step, at = walk(rows["id"].to_numpy(), rows["nxt"].to_numpy(), first)
        points = rows.select(["frame_id", *columns]).take(pa.array(at))
        return pa.Table.from_arrays([points["frame_id"], pa.chunked_array([first[which]]), pa.chunked_array([step]), *[points[c] for c in columns]], schema=schema)

    return run


def pieces(rows: DataFrame, starts: DataFrame, tile: int, columns: dict[str, str]) -> DataFrame:
    """(frame_id, start, step, ...) of the places on every piece.

    ``rows`` (frame_id, w, id, nxt, ...) are all nodes, ``starts`` (frame_id, w, id) the starts of
    pieces, each once; ``columns`` names those of ``rows`` to return, with their types.
    """
    placed = lambda df: df.withColumns({"ty": F.expr(f"id div w div {tile}"), "tx": F.expr(f"id % w div {tile}")})
    keys = ["frame_id", "ty", "tx"]
    ddl = "frame_id string, start long, step long, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    nodes = placed(rows.select(*dict.fromkeys(["frame_id", "w", "id", "nxt", *columns])))
    wanted = placed(starts.select("frame_id", "w", "id"))
    return nodes.groupBy(*keys).cogroup(wanted.select(*[F.col(c).alias(c) for c in (*keys, "id")]).groupBy(*keys)).applyInArrow(_walk_tile(list(columns), schema), ddl)
