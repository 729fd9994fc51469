"""Structured Streaming forms of the depth and session operators. An addition: batch and stream give the same rows once closed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sweep
from ..session import shared_folder


def depth_bins(segments: DataFrame, size: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Covered bases per bin over a stream of segments: the batch operator's own aggregation, kept as state (update or complete mode)."""
    return sweep.depth_bins(segments, size, keys)


def event_sessions(events: DataFrame, time: str, keys: tuple[str, ...], gap: str, lateness: str) -> DataFrame:
    """Events of a key within ``gap`` of each other as one session: (keys, start, end, events). Rows later than ``lateness`` are dropped by the watermark."""
    windows = events.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap).alias("_w"))
    return windows.agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def event_windows(events: DataFrame, time: str, keys: tuple[str, ...], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows of events: (keys, start, end, events)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.withWatermark(time, lateness).groupBy(*keys, window.alias("_w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs an aggregating stream over what is there now; its last full result is a Parquet table in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    query = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/table")
