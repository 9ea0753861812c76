"""Queries over telemetry, series, health rows and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import exposition, health, ingest, requests, series, telemetry
from querybook import inputs

HALF_DAY = {"interval": "43200 seconds", "interval_seconds": 43200.0}
AS_OF = "2024-01-30 12:00:00"
LIMIT, WINDOW = 4, 86400


def _rounded(df, *columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


def worker_performance(spark, sf):
    rows = telemetry.worker_performance(inputs.processed(spark, sf), ["host", "worker"])
    return _rounded(rows, "rate").drop("last_ts")


def recent_average(spark, sf):
    return telemetry.recent_average(inputs.processed(spark, sf), ["worker"], 100)


def sink_intervals(spark, sf):
    rows = telemetry.sink_intervals(inputs.operations(spark, sf), ["topic"], **HALF_DAY)
    kept = rows.withColumn("max_send_us", F.col("max_stages")["send"]).drop("max_stages")
    return _rounded(kept, "ops_per_sec", "slow_pct", places=9)


def sink_cumulative(spark, sf):
    rows = telemetry.sink_intervals(inputs.operations(spark, sf), ["topic"], **HALF_DAY)
    return _rounded(telemetry.sink_cumulative(rows, ["topic"]), "slow_pct")


def slow_sink_intervals(spark, sf):
    rows = telemetry.slow_sink_intervals(inputs.operations(spark, sf), ["topic"], "43200 seconds")
    sends = F.array_join(F.transform("recent_stages", lambda s: s["send"].cast("string")), ",")
    return rows.withColumn("recent_sends", sends).drop("recent_stages")


def stage_breakdown(spark, sf):
    rows = telemetry.sink_intervals(inputs.operations(spark, sf), ["topic"], **HALF_DAY)
    parts = telemetry.stage_breakdown(rows, ["topic", "interval_start"])
    return _rounded(parts, *[f"{s}_pct" for s in telemetry.STAGES])


def queue_intervals(spark, sf):
    rows = telemetry.queue_intervals(inputs.queue_samples(spark, sf), ["queue"], telemetry.nearly_full(), **HALF_DAY)
    return _rounded(rows, "throughput", places=9)


def event_queue_intervals(spark, sf):
    samples = inputs.queue_samples(spark, sf).withColumn("capacity", F.lit(950).cast("bigint"))
    rows = telemetry.queue_intervals(samples, ["queue"], telemetry.at_capacity(), **HALF_DAY)
    return rows.select("queue", "interval_start", "queue_full_count", "max_queue_size", "last_queue_size")


def queue_cumulative(spark, sf):
    rows = telemetry.queue_intervals(inputs.queue_samples(spark, sf), ["queue"], telemetry.nearly_full(), **HALF_DAY)
    return telemetry.queue_cumulative(rows, ["queue"])


def last_worker_values(spark, sf):
    return telemetry.last_values(inputs.processed(spark, sf), ["worker"], ["elapsed_us", "alert_id"])


def capacity_utilization(spark, sf):
    rows = telemetry.queue_intervals(inputs.queue_samples(spark, sf), ["queue"], telemetry.nearly_full(), **HALF_DAY)
    return _rounded(telemetry.capacity_utilization(rows, ["interval_start"]), "capacity_utilization")


def service_metrics(spark, sf):
    return telemetry.service_metrics(inputs.processed(spark, sf), ["worker"])


def resource_trends(spark, sf):
    rows = series.resource_trends(inputs.resources(spark, sf), ["host"])
    return _rounded(rows.drop("ts", "cpu_percent", "memory_percent"), "cpu_trend", "memory_trend")


def throughput_cpu_correlation(spark, sf):
    return series.throughput_cpu_correlation(inputs.resources(spark, sf), inputs.sink_samples(spark, sf), ["host"])


def memory_degradation(spark, sf):
    return series.memory_degradation(inputs.worker_samples(spark, sf), inputs.resources(spark, sf), ["host"], ["worker"])


def high_throughput_mode(spark, sf):
    rows = series.high_throughput_mode(inputs.queue_samples(spark, sf), ["queue"])
    return rows.select("seq", "queue", "high_throughput")


def stalled_workers(spark, sf):
    at = F.lit(AS_OF).cast("timestamp")
    rows = inputs.processed(spark, sf).where(F.col("ts") <= at)
    return series.stalled_workers(rows, ["host", "worker"], at, 1800.0)


def outages(spark, sf):
    return series.outages(inputs.polls(spark, sf), ["host"])


def history_retention(spark, sf):
    at = F.lit(AS_OF).cast("timestamp")
    rows = inputs.processed(spark, sf).where(F.col("ts") <= at)
    return series.retained_history(rows, at, [], 86400 * 3, 500).select("seq", "worker", "ts")


def queue_fill_severity(spark, sf):
    rows = inputs.queue_samples(spark, sf)
    fill = telemetry.fill_pct(F.col("size"), F.col("capacity"))
    return rows.select("seq", series.queue_fill_severity(fill).alias("severity"))


def slow_alert_severity(spark, sf):
    rows = inputs.processed(spark, sf)
    return rows.select("seq", series.slow_alert_severity(telemetry.seconds(F.col("elapsed_us")) * 3).alias("severity"))


def slow_alert_quarantine(spark, sf):
    rows = inputs.processed(spark, sf)
    slow = ingest.slow_alerts_to_quarantine(rows, telemetry.seconds(F.col("elapsed_us")), 3.0)
    return slow.select("seq", "alert_id", "reason")


def worker_intervals(spark, sf):
    rows = telemetry.worker_performance(inputs.processed(spark, sf), ["worker"], 43200.0, interval=HALF_DAY["interval"])
    return _rounded(rows, "rate").select(
        "worker", "interval_start", "alerts_processed", "total_us", "slow_alerts", "last_alert_id", "rate"
    )


def _telemetry_events(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    kinds = F.array(*[F.lit(k) for k in (*series.ROUTED_EVENTS, "service_performance")])
    return inputs.events(spark, sf).select(
        "event_id", "ts", F.get(kinds, (e % 4).cast("int")).alias("event_type"), (e % 3).alias("extremely_slow_alerts"),
        (v / 8).alias("last_processing_time"), (v / 10).alias("total_time"), (v / 15).alias("error_rate"),
        (v / 60).alias("avg_response_time"),
    )


def immediate_alerts(spark, sf):
    return series.immediate_alerts(_telemetry_events(spark, sf)).select("event_id", "event_type")


def event_routing(spark, sf):
    return series.route(_telemetry_events(spark, sf)).groupBy("route").agg(F.count(F.lit(1)).alias("events"))


def worker_status(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    idle = F.when(e % 4 != 0, e % 90)
    status = health.worker_status(idle, v - 5, e % 50, e % 9, v / 40, v / 10)
    return inputs.events(spark, sf).select("event_id", status.alias("status"))


def queue_status(spark, sf):
    fill = telemetry.fill_pct(F.col("size"), F.col("capacity"))
    return inputs.queue_samples(spark, sf).select("seq", health.queue_status(fill).alias("status"))


def service_status(spark, sf):
    rows = inputs.services(spark, sf)
    status = health.service_status(
        *[F.col(c) for c in ("is_healthy", "is_connected", "error_rate", "service_type", "avg_response", "latency")]
    )
    return rows.select("event_id", status.alias("status"))


def system_status(spark, sf):
    e = F.col("seq")
    status = health.system_status(F.col("cpu_percent"), F.col("memory_percent"), e % 1000, (e % 2) * 1000)
    return inputs.resources(spark, sf).select("seq", status.alias("status"))


def overall_status(spark, sf):
    return _rounded(health.overall_status(inputs.components(spark, sf), ["snapshot_id"]), "health_score")


def queue_health(spark, sf):
    rows = inputs.queue_samples(spark, sf)
    named = rows.withColumnsRenamed({"size": "current_size", "capacity": "config_max_size"})
    return health.with_queue_health(named).select(
        "seq", "utilization_percentage", "status", "is_healthy", "risk_level"
    )


def worker_health(spark, sf):
    e = F.col("event_id")
    rows = inputs.events(spark, sf).select(
        "event_id", (e % 3 != 0).alias("alive"), (e % 7).alias("slow_alerts"), (e % 50).alias("alerts_processed")
    )
    return _rounded(health.with_worker_health(rows), "slow_percentage")


def system_health(spark, sf):
    rows = inputs.resources(spark, sf).withColumn("status", F.when(F.col("seq") % 6 == 0, "DEGRADED").otherwise("healthy"))
    return health.with_system_health(rows).select("seq", "is_healthy", "resource_pressure")


def queue_summary(spark, sf):
    rows = inputs.queue_samples(spark, sf)
    named = rows.withColumnsRenamed({"size": "current_size", "capacity": "config_max_size"})
    days = health.with_queue_health(named).withColumn("day", F.date_trunc("day", "ts"))
    return _rounded(health.queue_summary(days, ["day"]), "average_utilization")


def worker_summary(spark, sf):
    e = F.col("event_id")
    rows = inputs.events(spark, sf).select(
        F.date_trunc("day", "ts").alias("day"), (e % 3 != 0).alias("healthy"), (e % 4 == 0).alias("processing")
    )
    return health.worker_summary(rows, ["day"])


def component_summary(spark, sf):
    return health.component_summary(inputs.components(spark, sf), ["snapshot_id"])


def quick_status(spark, sf):
    return health.quick_status(inputs.components(spark, sf), ["snapshot_id"])


def readiness(spark, sf):
    rows = inputs.components(spark, sf)
    overall = health.overall_status(rows, ["snapshot_id"])
    summary = health.component_summary(rows, ["snapshot_id"]).select("snapshot_id", "total_workers", "system_healthy")
    return health.readiness(overall.join(summary, "snapshot_id")).select(
        "snapshot_id", "overall_status", "workers_available", "system_healthy", "ready"
    )


def detailed_report(spark, sf):
    return _rounded(health.detailed_report(inputs.components(spark, sf), ["snapshot_id"]), "health_score")


def prometheus_lines(spark, sf):
    rows = inputs.metric_rows(spark, sf)
    overall = health.overall_status(rows, ["snapshot_id"])
    snapshots = overall.withColumn("kind", F.lit("snapshot"))
    return exposition.prometheus_lines(rows.unionByName(snapshots, allowMissingColumns=True), ["snapshot_id"])


def row_validation(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    rows = inputs.events(spark, sf).select(
        "event_id", F.when(e % 31 != 0, F.concat(F.lit("q"), e % 5)).alias("queue_name"), (e % 40 - 1).alias("current_size"),
        (e % 60).alias("max_size"), (e % 60).alias("config_max_size"), v.alias("utilization_percentage"),
        (e - 50).alias("total_processed"), v.alias("processing_rate"), (e % 3).alias("queue_full_events"),
        (v - 1).alias("avg_wait_time"),
    )
    checked = health.validated(rows, "queue")
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


def _violations(rows, kind):
    return health.validated(rows, kind).select("event_id", F.array_join("violations", ",").alias("violations"))


def worker_validation(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    rows = inputs.events(spark, sf).select(
        "event_id", F.when(e % 31 != 0, " w ").alias("worker_name"), (e % 40 - 1).alias("alerts_processed"),
        v.alias("processing_rate"), v.alias("avg_processing_time"), (v - 1).alias("recent_avg_processing_time"),
        v.alias("min_processing_time"), v.alias("max_processing_time"), (e % 3).alias("slow_alerts_count"),
        (e % 50 - 2).alias("extremely_slow_alerts_count"), v.alias("last_processing_time"),
        F.when(e % 7 != 0, "a").alias("last_alert_id"), (v / 100).alias("health_score"),
    )
    return _violations(rows, "worker")


def system_validation(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    rows = inputs.events(spark, sf).select(
        "event_id", (e % 20).alias("process_id"), F.when(e % 31 != 0, "p").alias("process_name"), v.alias("cpu_percent"),
        (e % 120).alias("memory_percent"), (v - 1).alias("memory_usage_mb"), (e % 9).alias("open_files_count"),
        (e % 9 - 1).alias("max_open_files"), v.alias("uptime_seconds"), (e % 13).alias("threads_count"),
    )
    return _violations(rows, "system")


def service_validation(spark, sf):
    e = F.col("event_id")
    rows = inputs.events(spark, sf).select(
        "event_id", F.when(e % 31 != 0, "s").alias("service_name"), F.when(e % 6 != 0, e % 2 == 0).alias("is_healthy"),
        F.when(e % 5 != 0, "HEALTHY").alias("status"),
    )
    return _violations(rows, "service")


def snapshot_validation(spark, sf):
    rows = inputs.events(spark, sf).select("event_id", (F.col("value") - 5).alias("health_score"))
    return _violations(rows, "snapshot")


def rate_limit(spark, sf):
    return requests.rate_limit(inputs.requests(spark, sf), LIMIT, WINDOW)


def sender_intervals(spark, sf):
    """Interval statistics over the largest table, a third of it from one sender."""
    rows = telemetry.sink_intervals(inputs.line_operations(spark, sf), ["sender"], "86400 seconds", 86400.0)
    kept = rows.withColumn("max_prep_us", F.col("max_stages")["prep"]).drop("max_stages")
    return _rounded(kept, "ops_per_sec", "slow_pct", places=9)


QUERIES = [
    worker_performance, recent_average, sink_intervals, sink_cumulative, slow_sink_intervals, stage_breakdown,
    queue_intervals, event_queue_intervals, queue_cumulative, last_worker_values, capacity_utilization, service_metrics,
    resource_trends, throughput_cpu_correlation, memory_degradation, high_throughput_mode, stalled_workers, outages,
    history_retention, queue_fill_severity, slow_alert_severity, immediate_alerts, event_routing, worker_status,
    queue_status, service_status, system_status, overall_status, queue_health, worker_health, system_health,
    queue_summary, worker_summary, component_summary, quick_status, readiness, detailed_report, prometheus_lines,
    row_validation, worker_validation, system_validation, service_validation, snapshot_validation, rate_limit, sender_intervals, slow_alert_quarantine, worker_intervals,
]
