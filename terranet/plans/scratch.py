"""Materialised intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the shared
checkpoint folder and reading it back.  Unlike an RDD checkpoint the plan runs
once, the files carry size statistics (so Catalyst may broadcast a side whose
size it knows), and a lost executor only re-reads files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as configured on the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="terranet-")
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/terranet-{app}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "t", compression: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder, in row groups of some ``group_bytes``, and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
