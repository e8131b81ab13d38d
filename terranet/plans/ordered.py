"""Prefix sums and next-row lookups within keys, safe for very large keys.

A plain window puts all rows of a key into one task.  Here rows are range-partitioned
on (key, order), each block is scanned on its own, and a small table with one row
per (key, block) carries totals across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.plans.scratch import cut


def _blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return cut(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def sums_before(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Add ``<col>_before``: sum of ``col`` over all earlier rows of the same key.

    ``df`` must be materialised.
    """
    blocks = _blocks(df, keys, order)
    totals = blocks.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_sum_{c}") for c in cols])
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_sum_{c}").over(over), F.lit(0)).alias(f"_carried_{c}") for c in cols])
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
    return local.join(carry, [*keys, "_block"]).select(
        *df.columns, *[(F.col(f"{c}_before") + F.col(f"_carried_{c}")).alias(f"{c}_before") for c in cols])


def following(df: DataFrame, keys: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """Add ``name``: ``col`` of the next row of the same key, NULL for the last.

    ``df`` must be materialised.
    """
    blocks = _blocks(df, keys, order)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = blocks.withColumns({name: F.lead(col).over(inner), "_nth": F.row_number().over(inner)})
    heads = local.filter("_nth = 1").select(*keys, "_block", F.col(col).alias("_head"))
    carry = heads.select(*keys, "_block", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next"))
    return local.join(carry, [*keys, "_block"]).withColumn(name, F.coalesce(name, "_next")).drop("_next", "_nth", "_block")
