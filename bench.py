"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Each query runs once to warm up and then twice; the better time counts.  Results
go to the ``noop`` sink, so every row and column is produced and none collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from alertloom.session import configure
from querybook import inputs
from querybook.registry import registered

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "strict_parse", "alert_relevance", "windows_messages", "syslog_messages", "message_values", "ack_lines",
    "outgoing_records", "ingest_stats", "global_addresses", "network_allowlist_table", "worker_performance",
    "recent_average", "sink_intervals", "slow_sink_intervals", "queue_intervals", "resource_trends",
    "throughput_cpu_correlation", "high_throughput_mode", "outages", "overall_status", "prometheus_lines",
    "rate_limit", "sender_intervals", "keep_latest",
)


def _once(query, spark) -> float:
    began = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("alertloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    known = registered()
    times = {}
    for name in HEADLINE:
        _once(known[name], spark)
        times[name] = round(min(_once(known[name], spark) for _ in range(2)), 3)
    alerts = inputs.events(spark, SF_DIR).count()
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": int(CPUS), "spark": spark.version,
                "state": "warm", "alerts_per_second": round(alerts / times["outgoing_records"]),
                "telemetry_rows_per_second": round(rows / times["sender_intervals"]),
            }
        )
    )


if __name__ == "__main__":
    main()
