"""The streaming forms over the event table, run until its rows are used up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from alertloom.operators import telemetry as batch_telemetry
from alertloom.plans.alert_plan import AlertJob
from alertloom.session import checkpoint_folder
from alertloom.streaming import alert_stream as alerts
from alertloom.streaming import correctable
from alertloom.streaming import rate_limit_stream as limits
from querybook import inputs
from querybook.telemetry import HALF_DAY, LIMIT, WINDOW


def _home(spark, name):
    """A folder of its own for every run, below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="run-")
    return f"{checkpoint_folder(spark, base)}/{name}-{uuid.uuid4()}"


def alert_stream(spark, sf):
    home = _home(spark, "alert_stream")
    lines = inputs.lines_of(inputs.event_stream(spark, sf)).withColumn("source_file", F.lit("events"))
    sinks = [alerts.folder_sink(f"{home}/{n}") for n in ("messages", "replies", "dead_letters")]
    batch = alerts.deliver(AlertJob("customer-1"), f"{home}/staging", *sinks)
    writer = lines.writeStream.option("checkpointLocation", f"{home}/progress").foreachBatch(batch)
    writer.trigger(availableNow=True).start().awaitTermination()
    replies = spark.read.parquet(f"{home}/replies").select("stream", "value")
    sent = spark.read.parquet(f"{home}/messages").select(F.lit("message").alias("stream"), "value")
    return sent.unionByName(replies)


def interval_stream(spark, sf):
    """Read from the stream's own table alone, whatever the order of the files."""
    home, keys = _home(spark, "interval_stream"), ["topic"]
    partials = lambda rows: batch_telemetry.sink_partials(rows, keys, HALF_DAY["interval"])
    rows = inputs.operations_of(inputs.event_stream(spark, sf))
    correctable.store(rows, f"{home}/table", f"{home}/progress", partials, keys, once=True).awaitTermination()
    found = correctable.sink_intervals(spark, f"{home}/table", keys, HALF_DAY["interval_seconds"])
    return found.select("topic", "interval_start", "operations", "slow_operations", "max_us")


def rate_limit_stream(spark, sf):
    home = _home(spark, "rate_limit_stream")
    decided = limits.rate_limit(inputs.requests_of(inputs.event_stream(spark, sf)), LIMIT, WINDOW)
    writer = decided.writeStream.format("parquet").option("path", f"{home}/table")
    writer.option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/table").select("request_id", "request_ts", "client", "accepted", "remaining", "reset_at")


QUERIES = [alert_stream, interval_stream, rate_limit_stream]
