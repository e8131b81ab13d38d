"""Headline queries, timed.  Prints one JSON line.

Every figure includes reading the table and all materialised steps before it:
nothing is shared between figures.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose
the data and the cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from terranet.operators import gradient as G, region as B
from terranet.operators.mesh import full_region
from terranet.plans.extract import extract_network
from terranet.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("terranet-bench")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="terranet-bench-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def tiled(cells: DataFrame, frames: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """The raster laid side by side ``times`` times, for the scaling figures."""
    wide = cells.join(frames.select("frame_id", "width"), "frame_id").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(
        "frame_id", (F.col("x") + F.col("k") * F.col("width")).cast("int").alias("x"), "y", "h")
    return wide, frames.withColumn("width", F.col("width") * times)


def main() -> None:
    spark = session()
    emb = lambda: tables.embeddings_raster(spark, SF_DIR)
    evt = lambda: tables.events_raster(spark, SF_DIR)

    def tree():
        net = extract_network(*emb())
        drain(net.tree.saddles)
        drain(net.tree.parents)

    queries = {
        "critical_emb": lambda: drain(G.critical(G.gradient(full_region(*emb())))),
        "catchments_emb": lambda: drain(extract_network(*emb()).flow.catchments()),
        "morse_cells_emb": lambda: drain(extract_network(*emb()).flow.cell_faces()),
        "merge_tree_emb": tree,
        "network_emb": lambda: drain(extract_network(*emb()).edges),
        "leg_points_emb": lambda: drain(extract_network(*emb()).points()),
        "network_evt": lambda: drain(extract_network(*evt()).edges),
        "data_regions_li": lambda: drain(B.data_regions(tables.lineitem_raster(spark, SF_DIR)[0])),
        "network_emb_x4": lambda: drain(extract_network(*tiled(*emb(), 4)).edges),
        "network_emb_x16": lambda: drain(extract_network(*tiled(*emb(), 16)).edges),
    }
    only = os.environ["BENCH_ONLY"].split(",") if os.environ.get("BENCH_ONLY") else list(queries)
    drain(extract_network(*tables.events_raster(spark, SF_DIR)).edges)  # warm up the JVM
    times = {}
    for name in only:
        begin = time.time()
        queries[name]()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
