"""Ranking linked lists and rings by pointer doubling (logarithmic rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terranet.plans.scratch import cut, is_empty


def rank_rings(links: DataFrame) -> DataFrame:
    """``links`` (frame_id, id, nxt) form rings; returns (frame_id, id, ring, pos).

    ``ring`` is the smallest id of the ring and has pos 0; positions follow nxt.
    """
    rows = cut(links.select("frame_id", "id", F.col("nxt").alias("ptr"), F.col("id").alias("ring"),
                            F.lit(0).cast("long").alias("dist"), F.lit(1).cast("long").alias("span")), "ring")
    while True:
        ahead = rows.select("frame_id", F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"),
                            F.col("ring").alias("_ring"), F.col("dist").alias("_dist"))
        better = F.col("_ring") < F.col("ring")
        rows = cut(rows.join(ahead, ["frame_id", "ptr"]).select(
            "frame_id", "id", F.col("_ptr").alias("ptr"), F.least("ring", "_ring").alias("ring"),
            F.when(better, F.col("span") + F.col("_dist")).otherwise(F.col("dist")).alias("dist"),
            (F.col("span") * 2).alias("span"), better.alias("moved")), "ring")
        if is_empty(rows.filter("moved")):
            break
    length = rows.groupBy("frame_id", "ring").agg(F.count("*").alias("n"))
    return rows.join(length, ["frame_id", "ring"]).select(
        "frame_id", "id", "ring", ((F.col("n") - F.col("dist")) % F.col("n")).alias("pos"))


def rank_lists(links: DataFrame) -> DataFrame:
    """``links`` (frame_id, id, nxt) form lists (nxt NULL at the end) and maybe rings.

    Returns (frame_id, id, tail, to_end): last id of the list and steps to it.
    Rings have no end; their rows are left out.
    """
    rows = cut(links.select("frame_id", "id", F.col("nxt").alias("ptr"), F.col("id").alias("tail"),
                            F.lit(0).cast("long").alias("to_end")), "list")
    total, reach = rows.count(), 1
    while reach <= total and not is_empty(rows.filter("ptr is not null")):
        ahead = rows.select("frame_id", F.col("id").alias("_id"), F.col("ptr").alias("_ptr"),
                            F.col("tail").alias("_tail"), F.col("to_end").alias("_to_end"))
        # rows that arrived keep a key of their own, away from NULL
        key = F.coalesce("ptr", -1 - F.abs(F.col("id")))
        joined = rows.withColumn("_key", key).join(
            ahead.withColumnRenamed("_id", "_key"), ["frame_id", "_key"], "left")
        going = F.col("ptr").isNotNull()
        rows = cut(joined.select(
            "frame_id", "id", F.when(going, F.col("_ptr")).alias("ptr"),
            F.when(going, F.col("_tail")).otherwise(F.col("tail")).alias("tail"),
            F.when(going, F.lit(reach) + F.col("_to_end")).otherwise(F.col("to_end")).alias("to_end")), "list")
        reach *= 2
    return rows.filter("ptr is null").select("frame_id", "id", "tail", "to_end")
