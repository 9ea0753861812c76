"""Health of workers, queues, services and hosts: status, score, summaries, checks.

Component rows carry the snapshot they belong to in ``keys`` (for example host
and snapshot time).  Classifiers are ordered CASE expressions; summaries are one
grouped aggregation each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.fixed_values import THRESHOLDS, Thresholds
from alertloom.operators.telemetry import fill_pct

HEALTHY, DEGRADED, CRITICAL = "HEALTHY", "DEGRADED", "CRITICAL"
ACTIVE, STALLED, IDLE = "ACTIVE", "STALLED", "IDLE"


def _is(status: Column | str, value: str) -> Column:
    """Status comparison without regard to case."""
    return F.upper(status) == value


# --- classifiers -------------------------------------------------------------


def worker_status(
    idle_seconds: Column, rate: Column, processed: Column, slow: Column, avg_seconds: Column, last_seconds: Column,
    t: Thresholds = THRESHOLDS,
) -> Column:
    """Status from activity and processing times; ``idle_seconds`` NULL skips the stall test."""
    slow_pct = F.when(processed > 0, slow / processed * 100)
    return (
        F.when(idle_seconds > t.worker_stall_seconds, STALLED)
        .when(rate <= 0, IDLE)
        .when(slow_pct > t.worker_slow_share_pct, STALLED)
        .when(
            (avg_seconds > t.worker_slow_seconds) | (last_seconds > t.worker_extremely_slow_seconds), STALLED
        )
        .otherwise(ACTIVE)
    )


def queue_status(utilization: Column, t: Thresholds = THRESHOLDS) -> Column:
    return (
        F.when(utilization >= t.queue_critical_pct, CRITICAL)
        .when(utilization >= t.queue_warning_pct, DEGRADED)
        .otherwise(HEALTHY)
    )


def service_status(
    is_healthy: Column, is_connected: Column, error_rate: Column, service_type: Column, avg_response: Column,
    latency: Column, t: Thresholds = THRESHOLDS,
) -> Column:
    """Status of a service; NULL fields count as connected, no errors, no delay."""
    errors = F.coalesce(error_rate, F.lit(0.0))
    response = F.when(F.coalesce(service_type, F.lit("unknown")) == "kafka", F.coalesce(avg_response, F.lit(0.0)))
    return (
        F.when(~is_healthy, CRITICAL)
        .when(~F.coalesce(is_connected, F.lit(True)), CRITICAL)
        .when(errors >= t.service_error_critical_pct, CRITICAL)
        .when(errors >= t.service_error_warning_pct, DEGRADED)
        .when(response >= t.sink_extremely_slow_seconds, CRITICAL)
        .when(response >= t.sink_slow_seconds, DEGRADED)
        .when(F.coalesce(latency, F.lit(0.0)) > t.service_latency_seconds, DEGRADED)
        .otherwise(HEALTHY)
    )


def system_status(
    cpu: Column, memory: Column, open_files: Column, max_open_files: Column, t: Thresholds = THRESHOLDS
) -> Column:
    """Status of a host; a warning on CPU hides what memory would say.

    Without a file limit the file test does not apply.
    """
    files = F.try_divide(open_files, max_open_files) * 100
    return (
        F.when(cpu >= t.cpu_critical_pct, CRITICAL)
        .when(cpu >= t.cpu_warning_pct, DEGRADED)
        .when(memory >= t.memory_critical_pct, CRITICAL)
        .when(memory >= t.memory_warning_pct, DEGRADED)
        .when(files >= t.open_files_critical_pct, CRITICAL)
        .when(files >= t.open_files_warning_pct, DEGRADED)
        .otherwise(HEALTHY)
    )


# --- derived fields ----------------------------------------------------------


def with_queue_health(queues: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Utilisation, status (limits exclusive), health flag and risk of queue rows.

    Input: ``current_size``, ``config_max_size``.
    """
    use = F.col("utilization_percentage")
    rows = queues.withColumn("utilization_percentage", fill_pct(F.col("current_size"), F.col("config_max_size")))
    rows = rows.withColumn(
        "status", F.when(use > t.queue_critical_pct, CRITICAL).when(use > t.queue_warning_pct, DEGRADED).otherwise(HEALTHY)
    )
    return rows.withColumn("is_healthy", _is("status", HEALTHY) & (use < 80.0)).withColumn(
        "risk_level", F.when(use >= 90.0, CRITICAL).when(use >= 70.0, "WARNING").otherwise("LOW")
    )


def with_worker_health(workers: DataFrame) -> DataFrame:
    """Status and score from liveness, health flag, share of slow alerts.

    Input: ``alive``, ``slow_alerts``, ``alerts_processed``.
    """
    rows = workers.withColumn("status", F.when(F.col("alive"), ACTIVE).otherwise(STALLED))
    rows = rows.withColumn("health_score", F.when(F.col("alive"), 0.8).otherwise(0.2))
    return rows.withColumn("is_healthy", _is("status", ACTIVE) & (F.col("health_score") >= 0.7)).withColumn(
        "slow_percentage", F.col("slow_alerts") / F.greatest("alerts_processed", F.lit(1)) * 100
    )


def with_system_health(samples: DataFrame) -> DataFrame:
    """Health flag and resource pressure of host samples with a ``status``."""
    cpu, memory = F.col("cpu_percent"), F.col("memory_percent")
    pressure = (
        F.when((cpu > 90) | (memory > 95), "HIGH").when((cpu > 70) | (memory > 80), "MEDIUM").otherwise("LOW")
    )
    return samples.withColumn("is_healthy", (cpu < 80) & (memory < 85) & _is("status", HEALTHY)).withColumn(
        "resource_pressure", pressure
    )


# --- summaries ---------------------------------------------------------------


def queue_summary(queues: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over queue health rows; 0 and HEALTHY where there is no queue."""
    healthy = F.count_if("is_healthy")
    total = F.count(F.lit(1))
    return queues.groupBy(*keys).agg(
        total.alias("total_queues"),
        healthy.alias("healthy_queues"),
        F.coalesce(F.sum("current_size"), F.lit(0)).alias("total_pending"),
        F.coalesce(F.avg("utilization_percentage"), F.lit(0.0)).alias("average_utilization"),
        F.when(healthy == total, HEALTHY).otherwise(DEGRADED).alias("status"),
    )


def worker_summary(workers: DataFrame, keys: list[str]) -> DataFrame:
    """Total, healthy and processing workers; input has booleans ``healthy``, ``processing``."""
    return workers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("healthy").alias("healthy"), F.count_if("processing").alias("processing")
    )


KINDS = ("worker", "queue", "service")


def component_summary(components: DataFrame, keys: list[str]) -> DataFrame:
    """Healthy and total components per kind, and the host's own flag.

    Input: ``kind`` (worker, queue, service, system) and ``is_healthy``.
    """
    counts = [
        c
        for kind in KINDS
        for c in (
            F.count_if((F.col("kind") == kind) & F.col("is_healthy")).alias(f"healthy_{kind}s"),
            F.count_if(F.col("kind") == kind).alias(f"total_{kind}s"),
        )
    ]
    system = F.coalesce(F.bool_and(F.when(F.col("kind") == "system", F.col("is_healthy"))), F.lit(False))
    return components.groupBy(*keys).agg(*counts, system.alias("system_healthy"))


def overall_status(components: DataFrame, keys: list[str]) -> DataFrame:
    """Status and score of a snapshot from its components' ``kind`` and ``status``.

    The worst of system, services and queues decides in that order.  Otherwise
    the score is the share of healthy components, the system counted as one.
    """

    def count(kind: str, status: str) -> Column:
        return F.count_if((F.col("kind") == kind) & _is("status", status))

    sound = (
        count("system", HEALTHY) + count("service", HEALTHY) + count("queue", HEALTHY) + count("worker", ACTIVE)
    )
    workers = F.count_if(F.col("kind") == "worker")
    rows = components.groupBy(*keys).agg(
        count("system", CRITICAL).alias("_system_critical"),
        count("service", CRITICAL).alias("_services_critical"),
        count("queue", CRITICAL).alias("_queues_critical"),
        (count("service", DEGRADED) + count("queue", DEGRADED) + count("system", DEGRADED)).alias("_degraded"),
        (count("worker", STALLED) > workers / 2).alias("_mostly_stalled"),
        (sound / (F.count_if(F.col("kind").isin(*KINDS)) + 1) * 100).alias("_score"),
    )
    score = F.col("_score")
    cases = (
        (F.col("_system_critical") > 0, CRITICAL, F.lit(0.0)),
        (F.col("_services_critical") > 0, CRITICAL, F.lit(10.0)),
        (F.col("_queues_critical") > 0, CRITICAL, F.lit(20.0)),
        (F.col("_degraded") > 0, DEGRADED, F.greatest(score, F.lit(30.0))),
        (F.col("_mostly_stalled"), DEGRADED, F.greatest(score, F.lit(40.0))),
        (F.lit(True), HEALTHY, score),
    )
    return rows.select(
        *keys,
        F.coalesce(*[F.when(test, F.lit(status)) for test, status, _ in cases]).alias("overall_status"),
        F.coalesce(*[F.when(test, value) for test, _, value in cases]).alias("health_score"),
    )


def quick_status(components: DataFrame, keys: list[str]) -> DataFrame:
    """Operational if no kind of worker and service is without a healthy member."""
    rows = components.groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == k).alias(f"total_{k}s") for k in ("worker", "service")],
        *[F.count_if((F.col("kind") == k) & F.col("is_healthy")).alias(f"healthy_{k}s") for k in ("worker", "service")],
    )
    fine = lambda k: (F.col(f"total_{k}s") == 0) | (F.col(f"healthy_{k}s") > 0)
    partly = lambda k: F.col(f"healthy_{k}s") < F.col(f"total_{k}s")
    status = (
        F.when(~(fine("worker") & fine("service")), CRITICAL)
        .when(partly("worker") | partly("service"), DEGRADED)
        .otherwise(HEALTHY)
    )
    return rows.withColumn("status", status)


def readiness(snapshots: DataFrame) -> DataFrame:
    """Ready: not critical and with at least one worker.

    Input: ``overall_status``, ``total_workers``, ``system_healthy``.
    """
    workers = F.col("total_workers") > 0
    return snapshots.withColumn("workers_available", workers).withColumn(
        "ready", ~_is("overall_status", CRITICAL) & workers
    )


def detailed_report(components: DataFrame, keys: list[str]) -> DataFrame:
    """Report rows: one per snapshot and per section with totals and status, one per component below.

    The row of section ``snapshot`` has the overall status and score.  Input: ``kind``, ``name``, ``status``, ``is_healthy``, ``detail`` (JSON text).
    A section without components is HEALTHY.  Rows instead of one nested document
    keep a snapshot with very many components distributed.
    """
    section = F.col("kind")
    every_snapshot = components.groupBy(*keys).agg(
        *[
            F.struct(
                F.count_if(section == k).alias("total"),
                F.count_if((section == k) & _is("status", ACTIVE)).alias("active"),
                F.count_if((section == k) & ~F.col("is_healthy")).alias("unhealthy"),
            ).alias(k)
            for k in ("system", *KINDS)
        ]
    )
    sections = every_snapshot.select(
        *keys,
        F.explode(F.create_map(*[x for k in ("system", *KINDS) for x in (F.lit(k), F.col(k))])).alias("section", "n"),
    ).select(
        *keys,
        "section",
        F.lit("").alias("name"),
        F.when(F.col("n.unhealthy") == 0, HEALTHY).otherwise(DEGRADED).alias("status"),
        F.col("n.total").alias("total"),
        F.when(F.col("section") == "worker", F.col("n.active")).alias("active"),
        F.lit(None).cast("string").alias("detail"),
    )
    overall = overall_status(components, keys).select(
        *keys, F.lit("snapshot").alias("section"), F.lit("").alias("name"), F.col("overall_status").alias("status"), "health_score"
    )
    items = components.select(
        *keys,
        F.col("kind").alias("section"),
        "name",
        "status",
        F.lit(None).cast("bigint").alias("total"),
        F.lit(None).cast("bigint").alias("active"),
        "detail",
    )
    return sections.unionByName(items).unionByName(overall, allowMissingColumns=True)


# --- row validation ----------------------------------------------------------

NON_NEGATIVE, PERCENT, UNIT, POSITIVE = "ge0", "pct", "unit", "gt0"
TEXT, BOOLEAN = "text", "flag"

RULES = {
    "worker": {
        "worker_name": TEXT, "alerts_processed": NON_NEGATIVE, "processing_rate": NON_NEGATIVE,
        "avg_processing_time": NON_NEGATIVE, "recent_avg_processing_time": NON_NEGATIVE,
        "min_processing_time": NON_NEGATIVE, "max_processing_time": NON_NEGATIVE,
        "slow_alerts_count": NON_NEGATIVE, "extremely_slow_alerts_count": NON_NEGATIVE,
        "last_processing_time": NON_NEGATIVE, "last_alert_id": TEXT, "health_score": UNIT,
    },
    "queue": {
        "queue_name": TEXT, "current_size": NON_NEGATIVE, "max_size": NON_NEGATIVE,
        "config_max_size": NON_NEGATIVE, "utilization_percentage": PERCENT, "total_processed": NON_NEGATIVE,
        "processing_rate": NON_NEGATIVE, "queue_full_events": NON_NEGATIVE, "avg_wait_time": NON_NEGATIVE,
    },
    "system": {
        "process_id": POSITIVE, "process_name": TEXT, "cpu_percent": PERCENT, "memory_percent": PERCENT,
        "memory_usage_mb": NON_NEGATIVE, "open_files_count": NON_NEGATIVE, "max_open_files": NON_NEGATIVE,
        "uptime_seconds": NON_NEGATIVE, "threads_count": POSITIVE,
    },
    "service": {"service_name": TEXT, "is_healthy": BOOLEAN, "status": TEXT},
    "snapshot": {"health_score": "score"},
}

_RANGES = {
    NON_NEGATIVE: lambda c: c >= 0,
    POSITIVE: lambda c: c > 0,
    PERCENT: lambda c: c.between(0, 100),
    "score": lambda c: c.between(0, 100),
    UNIT: lambda c: c.between(0, 1),
}


def violations(kind: str) -> Column:
    """Names of the fields of a health row that are missing or out of range."""
    checks = [
        F.when(~F.coalesce(_RANGES[rule](F.col(name)) if rule in _RANGES else F.col(name).isNotNull(), F.lit(False)), name)
        for name, rule in RULES[kind].items()
    ]
    return F.array_compact(F.array(*checks))


def validated(rows: DataFrame, kind: str) -> DataFrame:
    """Adds ``violations``; text fields are trimmed first, as the models do."""
    texts = [c for c, rule in RULES[kind].items() if rule == TEXT and c in rows.columns]
    trimmed = reduce(lambda df, c: df.withColumn(c, F.trim(c)), texts, rows)
    return trimmed.withColumn("violations", violations(kind))
