"""Health snapshots as Prometheus text, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.bind import let

# (metric, type, help text, kind of component, value field); order of the output.
METRICS = (
    ("health_score", "gauge", "Overall health score", "snapshot", "health_score"),
    (
        "overall_status", "gauge", "Overall system status (0=healthy, 1=degraded, 2=critical)",
        "snapshot", "overall_status",
    ),
    ("system_cpu_percent", "gauge", "CPU usage percentage", "system", "cpu_percent"),
    ("system_memory_percent", "gauge", "Memory usage percentage", "system", "memory_percent"),
    ("system_memory_usage_mb", "gauge", "Memory usage in MB", "system", "memory_usage_mb"),
    ("system_uptime_seconds", "gauge", "System uptime in seconds", "system", "uptime_seconds"),
    ("system_open_files_count", "gauge", "Number of open files", "system", "open_files_count"),
    ("system_threads_count", "gauge", "Number of threads", "system", "threads_count"),
    ("worker_alerts_processed", "counter", "Total alerts processed by worker", "worker", "alerts_processed"),
    ("worker_processing_rate", "gauge", "Worker processing rate", "worker", "processing_rate"),
    ("worker_health_score", "gauge", "Worker health score", "worker", "health_score"),
    ("queue_current_size", "gauge", "Current queue size", "queue", "current_size"),
    ("queue_utilization_percentage", "gauge", "Queue utilization percentage", "queue", "utilization_percentage"),
    ("queue_total_processed", "counter", "Total processed items", "queue", "total_processed"),
    ("service_is_connected", "gauge", "Service connection status", "service", "is_connected"),
    ("service_total_operations", "counter", "Total service operations", "service", "total_operations"),
    ("service_error_rate", "gauge", "Service error rate percentage", "service", "error_rate"),
)

FIELDS = sorted({field for *_, field in METRICS})
STATUS_NUMBERS = {"HEALTHY": "0", "DEGRADED": "1", "CRITICAL": "2"}


def number_text(value: Column) -> Column:
    """A double as Python prints it: shortest digits, exponents outside 1e-4 .. 1e16."""
    tries = [F.format_string(f"%.{places}e", F.abs(value)) for places in (14, 15, 16)]
    shortest = F.coalesce(*[F.when(t.cast("double") == F.abs(value), t) for t in tries], tries[-1])
    parts = F.split(shortest, "e")
    digits = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), r"(?<=.)0+\z", "")
    return let(F.struct(digits.alias("digits"), parts[1].cast("int").alias("exponent")), lambda n: _spelled(value, n))


def _spelled(value: Column, number: Column) -> Column:
    digits, exponent = number["digits"], number["exponent"]
    rest = F.substring(digits, 2, 40)
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), power)
    whole = F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))
    split_at = F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2, F.lit(40)))
    plain = (
        F.when(value == 0, "0.0")
        .when((F.abs(value) >= 1e16) | (F.abs(value) < 1e-4), scientific)
        .when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(F.length(digits) <= exponent + 1, whole)
        .otherwise(split_at)
    )
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), plain))


def _value(field: str, kinds: dict[str, str]) -> Column:
    c = F.col(field)
    if field == "overall_status":
        known = F.create_map(*[F.lit(x) for pair in STATUS_NUMBERS.items() for x in pair])
        return F.coalesce(known[F.upper(c)], F.lit("2"))
    if field == "is_connected":
        return F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0")
    if field == "health_score":
        shown = number_text(c)
        return F.when((F.col("kind") == "snapshot") & (F.coalesce(c, F.lit(0.0)) == 0), "0").otherwise(shown)
    if kinds[field] in ("double", "float"):
        return F.coalesce(number_text(c), F.lit("0.0"))
    return F.coalesce(c.cast("string"), F.lit("0"))


def _labels() -> Column:
    name = F.col("name")
    return (
        F.when(F.col("kind") == "worker", F.concat(F.lit('{worker="'), name, F.lit('"}')))
        .when(F.col("kind") == "queue", F.concat(F.lit('{queue="'), name, F.lit('"}')))
        .when(
            F.col("kind") == "service",
            F.concat(
                F.lit('{service="'), name, F.lit('",type="'), F.coalesce("service_type", F.lit("unknown")), F.lit('"}')
            ),
        )
        .otherwise("")
    )


def prometheus_lines(components: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of every snapshot: ``metric_rank``, ``line_rank``, ``name``, ``line``.

    Ordered by ``keys``, ``metric_rank``, ``line_rank``, ``name`` they are the
    exposition text.  Input rows: ``kind`` (snapshot, system, worker, queue,
    service), ``name``, ``service_type`` and the value fields.  Headings appear
    for every snapshot; those of the system only if it has a system row.
    """
    kinds = dict(components.dtypes)

    def samples(kind: str) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(rank).alias("metric_rank"),
                    F.lit(2).alias("line_rank"),
                    F.concat(F.lit(metric), F.col("_labels"), F.lit(" "), _value(field, kinds)).alias("line"),
                )
                for rank, (metric, _, _, owner, field) in enumerate(METRICS)
                if owner == kind
            ]
        )

    owners = dict.fromkeys(owner for *_, owner, _ in METRICS)
    of_row = F.coalesce(*[F.when(F.col("kind") == kind, samples(kind)) for kind in owners])
    lines = (
        components.withColumn("_labels", _labels())
        .select(*keys, "name", F.explode(of_row).alias("s"))
        .select(*keys, "s.metric_rank", "s.line_rank", F.coalesce("name", F.lit("")).alias("name"), "s.line")
    )
    headings = F.array(
        *[
            F.struct(
                F.lit(rank).alias("metric_rank"), F.lit(at).alias("line_rank"), F.lit(text).alias("line"),
                F.lit(kind).alias("kind"),
            )
            for rank, (metric, form, about, kind, _) in enumerate(METRICS)
            for at, text in ((0, f"# HELP {metric} {about}"), (1, f"# TYPE {metric} {form}"))
        ]
    )
    snapshots = components.groupBy(*keys).agg(F.bool_or(F.col("kind") == "system").alias("_has_system"))
    heads = (
        snapshots.select(*keys, "_has_system", F.explode(headings).alias("h"))
        .where((F.col("h.kind") != "system") | F.col("_has_system"))
        .select(*keys, "h.metric_rank", "h.line_rank", F.lit("").alias("name"), "h.line")
    )
    return heads.unionByName(lines)
