"""An extension beyond batch graphs: arcs that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_outdegrees(arcs: DataFrame) -> DataFrame:
    """(src, degree) so far, of a streaming table of arcs; for output modes update and complete."""
    return arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def windowed_arcs(arcs: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, arcs): arcs by time window, late ones up to ``late``."""
    return arcs.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("arcs"))


def append_arcs(arcs: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write distinct arcs of every micro-batch to a Parquet folder; ``after(batch, id)`` may follow each.

    A batch that is tried again after a failure overwrites its own folder, so that no arc stands twice.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("src", "dst").distinct().write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if after is not None:
            after(batch, epoch)

    return arcs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
