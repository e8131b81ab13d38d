"""Euler tours of forests: every subtree becomes an interval.

A tour walks down and up every edge of a tree once.  Its arcs form a linked list, which
pointer doubling ranks (``plans.lists``), for all trees at once and whatever their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terranet.plans.lists import rank_lists
from terranet.plans.ordered import following
from terranet.plans.scratch import cut

DOWN, UP = 0, 1


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs of the trees ``nodes`` (frame_id, id, parent; NULL at roots), materialised: (frame_id, node, way, tail, to_end).

    ``way`` is DOWN on the way into a node and UP on the way out; ``tail`` names the
    tour, ``to_end`` counts the arcs behind.  Children come in the order of their ids;
    those of a node with very many are looked up in blocks.  A root has both arcs too.
    """
    below = cut(nodes.filter("parent is not null").select("frame_id", "parent", "id"), "below")
    ordered = following(below, ["frame_id", "parent"], [F.col("id").asc()], "id", "sibling")
    first = below.groupBy("frame_id", F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    known = nodes.select("frame_id", "id", "parent").join(first, ["frame_id", "id"], "left").join(
        ordered.select("frame_id", "id", "sibling"), ["frame_id", "id"], "left")
    arc = lambda node, way: F.col(node) * 2 + way
    steps = F.array(F.struct(arc("id", DOWN).alias("id"), F.coalesce(arc("child", DOWN), arc("id", UP)).alias("nxt")),
                    F.struct(arc("id", UP).alias("id"), F.coalesce(arc("sibling", DOWN), arc("parent", UP)).alias("nxt")))
    links = cut(known.select("frame_id", F.explode(steps).alias("s")).select("frame_id", "s.*"), "arcs")
    return cut(rank_lists(links).select("frame_id", F.floor(F.col("id") / 2).cast("long").alias("node"), F.pmod("id", F.lit(2)).cast("int").alias("way"),
                                        "tail", "to_end"), "tour")


def intervals(arcs: DataFrame) -> DataFrame:
    """(frame_id, node, tail, low, high) of a tour: a node lies in a subtree if its ``high`` is in the subtree's low .. high."""
    return arcs.groupBy("frame_id", "node").agg(F.first("tail").alias("tail"), F.min("to_end").alias("low"), F.max("to_end").alias("high"))


def dyadic(low: Column, high: Column) -> Column:
    """The interval low .. high (both included) as few blocks (level, block) of 2^level places each."""
    state = F.struct(low.alias("low"), (high + 1).alias("end"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        lo, end = s["low"], s["end"]
        block = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.cast("long").alias("block")))
        nothing = F.array().cast("array<struct<level:int,block:bigint>>")
        left, right = (lo < end) & (lo % 2 == 1), (lo < end) & (end % 2 == 1)
        more = F.concat(s["out"], F.when(left, block(lo)).otherwise(nothing), F.when(right & ~(left & (lo + 1 == end)), block(end - 1)).otherwise(nothing))
        return F.struct(F.shiftright(lo + left.cast("int"), 1).alias("low"), F.shiftright(end, 1).alias("end"), more.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), state, step)["out"]


def within(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, keys: list[str]) -> DataFrame:
    """``points`` joined with all ``ranges`` that hold them, by equal keys and block: no point meets a range that does not hold it."""
    blocks = cut(ranges.withColumn("_b", F.explode(dyadic(F.col(low), F.col(high)))).select("*", "_b.level", "_b.block").drop("_b"), "ranges")
    levels = blocks.select(F.col("level").alias("_level")).distinct()
    spread = points.select("*", F.explode(F.array(*[F.lit(r["_level"]) for r in levels.collect()]).cast("array<int>")).alias("level"))  # 63 levels at most
    return spread.withColumn("block", F.expr(f"shiftright({at}, level)")).join(blocks, [*keys, "level", "block"]).drop("level", "block")
