"""Tumbling telemetry aggregates on streams, written to interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators import ingest, telemetry
from alertloom.session import checkpoint_folder

LATENESS = "10 minutes"


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Event time as an instant, which watermarks require."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def sink_intervals(operations: DataFrame, keys: list[str], lateness: str = LATENESS, **options) -> DataFrame:
    """``telemetry.sink_intervals`` in event time; rows later than ``lateness`` are left out."""
    return telemetry.sink_intervals(_timed(operations, lateness), keys, **options)


def queue_intervals(samples: DataFrame, keys: list[str], lateness: str = LATENESS, **options) -> DataFrame:
    return telemetry.queue_intervals(
        _timed(samples, lateness), keys, options.pop("full", telemetry.nearly_full()), **options
    )


def worker_intervals(
    processed: DataFrame, keys: list[str], interval: str = telemetry.INTERVAL, lateness: str = LATENESS, **options
) -> DataFrame:
    """``telemetry.worker_performance`` per interval."""
    return telemetry.worker_performance(_timed(processed, lateness), keys, interval=interval, **options)


def ingest_stats(parsed: DataFrame, keys: list[str], lateness: str = LATENESS, **options) -> DataFrame:
    """``ingest.ingest_stats`` over parsed lines with an event or arrival time ``ts``."""
    return ingest.ingest_stats(_timed(parsed, lateness), "ts", keys=keys, **options)


def completed(stored: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` intervals of a stream, and those of ``every`` that no watermark has closed yet.

    ``every`` is the batch form of the same aggregate over the raw rows kept so far.
    """
    same = [F.col(f"_every.{c}").eqNullSafe(F.col(f"_stored.{c}")) for c in (*keys, "interval_start")]
    still_open = every.alias("_every").join(stored.alias("_stored"), same, "left_anti")
    return stored.unionByName(still_open.select(*stored.columns))


def store(intervals: DataFrame, name: str, folder: str, *, once: bool = False, base: str | None = None) -> StreamingQuery:
    """Append finished intervals to a table that the series operators read."""
    home = checkpoint_folder(intervals.sparkSession, base)
    writer = (
        intervals.writeStream.queryName(name)
        .outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", f"{home}/{name}/progress")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
