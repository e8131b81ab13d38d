"""New frames of a time series as they arrive.

Frames are independent of each other, so a stream of them needs no state: every
micro-batch holds whole frames and is one run of the batch extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from terranet.operators.stencil import TILE
from terranet.plans.extract import Network, extract_network


def extract_arriving_frames(cells: DataFrame, sink: Callable[[Network, int], None], checkpoint: str,
                            x_res: float = 1.0, y_res: float = 1.0, tile: int = TILE,
                            **trigger) -> StreamingQuery:
    """Start extracting the networks of frames on a stream of dense cells (frame_id, x, y, h).

    A frame must arrive in one file, so that it lies within one micro-batch.
    ``sink(network, batch_id)`` stores what it needs and must overwrite by
    batch, since a batch may be repeated after a failure.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        frames = batch.groupBy("frame_id").agg((F.max("x") + 1).cast("int").alias("width"),
                                               (F.max("y") + 1).cast("int").alias("height")).select(
            "frame_id", F.lit(0).alias("frame_no"), "width", "height", F.lit(x_res).alias("x_res"), F.lit(y_res).alias("y_res"))
        sink(extract_network(batch, frames, tile=tile), batch_id)

    return cells.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
