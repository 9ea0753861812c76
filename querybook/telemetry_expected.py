"""Expected results of the telemetry queries, straight from the table columns."""

from __future__ import annotations

BASE = """
WITH ev AS (
  SELECT event_id AS e, user_id AS u, ts, event_type AS et, value AS v,
    round(value * 100)::BIGINT * 125 AS us, 'h' || (user_id % 3) AS host, 'w' || (user_id % 10) AS worker,
    time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS half, (event_id * 7919) % 1001 AS size,
    ((event_id * 37) % 1000) / 10.0::DOUBLE AS cpu, ((event_id * 53) % 1000) / 10.0::DOUBLE AS mem,
    floor(round(value * 100)::BIGINT * 125 * ((event_id % 5) + 1) / 40)::BIGINT AS prep,
    floor(round(value * 100)::BIGINT * 125 * ((event_id % 7) + 1) / 40)::BIGINT AS enc,
    floor(round(value * 100)::BIGINT * 125 * ((event_id % 29) + 1) / 40)::BIGINT AS send,
    CASE WHEN event_id % 5 = 0 THEN floor(round(value * 100)::BIGINT * 125 * ((event_id % 23) + 1) / 40)::BIGINT ELSE 0 END AS conn
  FROM events),
iv AS (
  SELECT et AS topic, half AS interval_start, count(*) AS operations, count(*) FILTER (us > 1000000) AS slow_operations,
    max(us) AS max_us, first(send ORDER BY us DESC, ts, e) AS max_send_us, max(us) FILTER (us > 1000000) AS slow_max_us,
    first([prep, enc, send, conn] ORDER BY us DESC, ts, e) AS st
  FROM ev GROUP BY 1, 2),
qi AS (
  SELECT et AS queue, half AS interval_start, sum(e % 5 + 1)::BIGINT AS total_processed, max(size) AS max_queue_size,
    count(*) FILTER (size > 800) AS queue_full_count, last(size ORDER BY ts, e) AS last_queue_size
  FROM ev GROUP BY 1, 2),
comp AS (
  SELECT e // 8 AS snapshot_id, e, v, e % 8 AS slot,
    CASE WHEN e % 8 = 0 THEN 'system' WHEN e % 8 <= 3 THEN 'worker' WHEN e % 8 <= 5 THEN 'queue' ELSE 'service' END AS kind
  FROM ev),
cs AS (
  SELECT *, kind || '-' || slot AS name, CASE
    WHEN kind = 'worker' THEN CASE WHEN v > 90 THEN 'STALLED' WHEN v < 3 THEN 'IDLE' ELSE 'ACTIVE' END
    WHEN v > 140 THEN 'CRITICAL' WHEN v > 90 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
  FROM comp),
ch AS (SELECT *, status IN ('HEALTHY', 'ACTIVE') AS ok FROM cs),
ov0 AS (
  SELECT snapshot_id, count(*) FILTER (kind = 'system' AND status = 'CRITICAL') AS a,
    count(*) FILTER (kind = 'service' AND status = 'CRITICAL') AS b, count(*) FILTER (kind = 'queue' AND status = 'CRITICAL') AS c,
    count(*) FILTER (kind <> 'worker' AND status = 'DEGRADED') AS d,
    count(*) FILTER (status = 'STALLED') > count(*) FILTER (kind = 'worker') / 2.0 AS st,
    count(*) FILTER (ok)::DOUBLE / (count(*) FILTER (kind <> 'system') + 1) * 100 AS score,
    count(*) FILTER (kind = 'worker') AS nw, bool_and(ok) FILTER (kind = 'system') AS sys_ok
  FROM ch GROUP BY 1),
ov AS (
  SELECT snapshot_id, nw, sys_ok,
    CASE WHEN a + b + c > 0 THEN 'CRITICAL' WHEN d > 0 OR st THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall_status,
    CASE WHEN a > 0 THEN 0.0 WHEN b > 0 THEN 10.0 WHEN c > 0 THEN 20.0 WHEN d > 0 THEN greatest(score, 30.0)
         WHEN st THEN greatest(score, 40.0) ELSE score END::DOUBLE AS health_score
  FROM ov0),
res AS (SELECT * FROM ev),
clk AS (SELECT * FROM ev WHERE et = 'click')
"""


def _q(select: str) -> str:
    return BASE + select


_METRICS = (
    ("health_score", "gauge", "Overall health score", "snapshot"),
    ("overall_status", "gauge", "Overall system status (0=healthy, 1=degraded, 2=critical)", "snapshot"),
    ("system_cpu_percent", "gauge", "CPU usage percentage", "system"),
    ("system_memory_percent", "gauge", "Memory usage percentage", "system"),
    ("system_memory_usage_mb", "gauge", "Memory usage in MB", "system"),
    ("system_uptime_seconds", "gauge", "System uptime in seconds", "system"),
    ("system_open_files_count", "gauge", "Number of open files", "system"),
    ("system_threads_count", "gauge", "Number of threads", "system"),
    ("worker_alerts_processed", "counter", "Total alerts processed by worker", "worker"),
    ("worker_processing_rate", "gauge", "Worker processing rate", "worker"),
    ("worker_health_score", "gauge", "Worker health score", "worker"),
    ("queue_current_size", "gauge", "Current queue size", "queue"),
    ("queue_utilization_percentage", "gauge", "Queue utilization percentage", "queue"),
    ("queue_total_processed", "counter", "Total processed items", "queue"),
    ("service_is_connected", "gauge", "Service connection status", "service"),
    ("service_total_operations", "counter", "Total service operations", "service"),
    ("service_error_rate", "gauge", "Service error rate percentage", "service"),
)

_VALUES = {
    "system_cpu_percent": "(e % 101)::DOUBLE::VARCHAR",
    "system_memory_percent": "(e % 89)::DOUBLE::VARCHAR",
    "system_memory_usage_mb": "v::VARCHAR",
    "system_uptime_seconds": "(e * 1.5)::DOUBLE::VARCHAR",
    "system_open_files_count": "(e % 300)::VARCHAR",
    "system_threads_count": "(e % 30 + 1)::VARCHAR",
    "worker_alerts_processed": "(e % 1000)::VARCHAR",
    "worker_processing_rate": "v::VARCHAR",
    "worker_health_score": "CASE WHEN status = 'ACTIVE' THEN '0.8' ELSE '0.2' END",
    "queue_current_size": "(e % 500)::VARCHAR",
    "queue_utilization_percentage": "(e % 500 / 8.0)::DOUBLE::VARCHAR",
    "queue_total_processed": "e::VARCHAR",
    "service_is_connected": "CASE WHEN e % 3 <> 0 THEN '1' ELSE '0' END",
    "service_total_operations": "CASE WHEN e % 4 <> 0 THEN e::VARCHAR ELSE '0' END",
    "service_error_rate": "CASE WHEN e % 4 <> 0 THEN v::VARCHAR ELSE '0.0' END",
}


def _prometheus() -> str:
    parts = []
    for rank, (metric, form, about, kind) in enumerate(_METRICS):
        for at, text in ((0, f"# HELP {metric} {about}"), (1, f"# TYPE {metric} {form}")):
            source = "(SELECT DISTINCT snapshot_id FROM ch WHERE kind = 'system')" if kind == "system" else "ov"
            parts.append(f"SELECT snapshot_id, {rank} AS metric_rank, {at} AS line_rank, '' AS name, '{text}' AS line FROM {source}")
        if metric == "health_score":
            value = "CASE WHEN health_score = 0 THEN '0' ELSE health_score::VARCHAR END"
        elif metric == "overall_status":
            value = "CASE overall_status WHEN 'HEALTHY' THEN '0' WHEN 'DEGRADED' THEN '1' ELSE '2' END"
        else:
            label = {
                "system": "''", "worker": "'{worker=\"' || name || '\"}'", "queue": "'{queue=\"' || name || '\"}'",
                "service": "'{service=\"' || name || '\",type=\"' || CASE WHEN e % 2 = 0 THEN 'kafka' ELSE 'unknown' END || '\"}'",
            }[kind]
            parts.append(
                f"SELECT snapshot_id, {rank}, 2, name, '{metric}' || {label} || ' ' || {_VALUES[metric]} FROM ch WHERE kind = '{kind}'"
            )
            continue
        parts.append(f"SELECT snapshot_id, {rank}, 2, '', '{metric} ' || {value} FROM ov")
    return _q(" UNION ALL ".join(parts))


_LAST3 = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
_LAST10 = "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"

_RATE_LIMIT = """
WITH RECURSIVE r AS (
  SELECT event_id AS request_id, ts AS request_ts, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'c' || user_id END AS client,
    row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'c' || user_id END ORDER BY ts, event_id) AS k
  FROM events),
f AS (
  SELECT request_id, request_ts, client, k, true AS accepted, [request_ts] AS times FROM r WHERE k = 1
  UNION ALL
  SELECT r.request_id, r.request_ts, r.client, r.k,
    len(list_filter(f.times, lambda t: t > r.request_ts - INTERVAL 86400 SECOND)) < 4,
    CASE WHEN len(list_filter(f.times, lambda t: t > r.request_ts - INTERVAL 86400 SECOND)) < 4
      THEN list_append(list_filter(f.times, lambda t: t > r.request_ts - INTERVAL 86400 SECOND), r.request_ts)
      ELSE list_filter(f.times, lambda t: t > r.request_ts - INTERVAL 86400 SECOND) END
  FROM f JOIN r ON r.client = f.client AND r.k = f.k + 1)
SELECT request_id, request_ts, client, accepted, (4 - len(times))::BIGINT AS remaining, times[1] + INTERVAL 86400 SECOND AS reset_at FROM f
"""

_SYSTEM = (
    "CASE WHEN cpu >= 95 THEN 'CRITICAL' WHEN cpu >= 80 THEN 'DEGRADED' WHEN mem >= 95 THEN 'CRITICAL' WHEN mem >= 85 THEN 'DEGRADED' "
    "WHEN e % 2 = 1 AND e % 1000 >= 950 THEN 'CRITICAL' WHEN e % 2 = 1 AND e % 1000 >= 800 THEN 'DEGRADED' ELSE 'HEALTHY' END"
)

EXPECTED = {
    "worker_performance": _q(
        "SELECT host, worker, count(*) AS alerts_processed, sum(us)::BIGINT AS total_us, sum(us)::DOUBLE / count(*) / 1e6 AS avg_processing, "
        "min(us) / 1e6 AS min_time, max(us) / 1e6 AS max_time, count(*) FILTER (us > 2000000 AND us <= 5000000) AS slow_alerts, "
        "count(*) FILTER (us > 5000000) AS extremely_slow_alerts, last(us ORDER BY ts, e) / 1e6 AS last_processing_time, "
        "last('a' || e ORDER BY ts, e) AS last_alert_id, "
        "round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS rate FROM ev GROUP BY 1, 2"
    ),
    "recent_average": _q(
        "SELECT worker, count(*) AS samples, sum(us)::DOUBLE / count(*) / 1e6 AS recent_avg FROM "
        "(SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, e DESC) AS k FROM ev) WHERE k <= 100 GROUP BY 1"
    ),
    "sink_intervals": _q(
        "SELECT topic, interval_start, operations, slow_operations, max_us, max_send_us, slow_max_us, "
        "round(operations / 43200.0::DOUBLE, 9) AS ops_per_sec, round(slow_operations::DOUBLE / operations * 100, 9) AS slow_pct FROM iv"
    ),
    "sink_cumulative": _q(
        "SELECT topic, interval_start, total_operations, total_slow, all_time_max_us, round(total_slow::DOUBLE / total_operations * 100, 6) AS slow_pct "
        "FROM (SELECT topic, interval_start, (sum(operations) OVER w)::BIGINT AS total_operations, (sum(slow_operations) OVER w)::BIGINT AS total_slow, "
        "coalesce(max(slow_max_us) OVER w, 0) AS all_time_max_us FROM iv WINDOW w AS (PARTITION BY topic ORDER BY interval_start))"
    ),
    "slow_sink_intervals": _q(
        ", slow AS (SELECT *, row_number() OVER (PARTITION BY et, half ORDER BY ts, e) AS k, "
        "max(us) OVER (PARTITION BY et, half) AS top FROM ev WHERE us > 1000000), "
        "peak AS (SELECT et, half, min(k) AS pk FROM slow WHERE us = top GROUP BY 1, 2), "
        "ex AS (SELECT slow.et, slow.half, string_agg(send::VARCHAR, ',' ORDER BY k) AS sends FROM slow JOIN peak "
        "ON slow.et = peak.et AND slow.half = peak.half WHERE k >= pk AND k < pk + 5 GROUP BY 1, 2) "
        "SELECT ev.et AS topic, ev.half AS interval_start, count(*) AS total_operations, count(*) FILTER (us > 1000000) AS slow_operations, "
        "coalesce(last(us ORDER BY ts, e) FILTER (us > 1000000), 0) AS last_slow_us, coalesce(max(us) FILTER (us > 1000000), 0) AS max_us, "
        "coalesce(any_value(ex.sends), '') AS recent_sends FROM ev LEFT JOIN ex ON ev.et = ex.et AND ev.half = ex.half GROUP BY 1, 2"
    ),
    "stage_breakdown": _q(
        ", s AS (SELECT *, (st[1] + st[2] + st[3] + st[4])::BIGINT AS t FROM iv WHERE slow_operations > 0), "
        "p AS (SELECT *, st[1]::DOUBLE / t * 100 AS a, st[2]::DOUBLE / t * 100 AS b, st[3]::DOUBLE / t * 100 AS c, st[4]::DOUBLE / t * 100 AS d FROM s) "
        "SELECT topic, interval_start, t AS total_us, round(a, 6) AS prep_pct, round(b, 6) AS encode_pct, round(c, 6) AS send_pct, "
        "round(d, 6) AS connect_pct, CASE WHEN greatest(a, b, c, d) <= 50 THEN NULL WHEN a = greatest(a, b, c, d) THEN 'prep' "
        "WHEN b = greatest(a, b, c, d) THEN 'encode' WHEN c = greatest(a, b, c, d) THEN 'send' ELSE 'connect' END AS bottleneck FROM p"
    ),
    "queue_intervals": _q(
        "SELECT *, 1000::BIGINT AS config_max_queue_size, round(total_processed / 43200.0::DOUBLE, 9) AS throughput FROM qi"
    ),
    "event_queue_intervals": _q(
        "SELECT et AS queue, half AS interval_start, count(*) FILTER (size >= 950) AS queue_full_count, max(size) AS max_queue_size, "
        "last(size ORDER BY ts, e) AS last_queue_size FROM ev GROUP BY 1, 2"
    ),
    "queue_cumulative": _q(
        "SELECT queue, interval_start, (sum(total_processed) OVER w)::BIGINT AS total_processed, max(max_queue_size) OVER w AS all_time_max_size, "
        "(sum(queue_full_count) OVER w)::BIGINT AS total_full_count FROM qi WINDOW w AS (PARTITION BY queue ORDER BY interval_start)"
    ),
    "last_worker_values": _q(
        "SELECT worker, ts, us AS elapsed_us, 'a' || e AS alert_id FROM ev QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, e DESC) = 1"
    ),
    "capacity_utilization": _q(
        "SELECT interval_start, round(avg(least(1.0::DOUBLE, last_queue_size::DOUBLE / max_queue_size)), 6) AS capacity_utilization FROM qi GROUP BY 1"
    ),
    "service_metrics": _q(
        ", r AS (SELECT worker, sum(us)::DOUBLE / count(*) / 1e6 AS a, count(*) FILTER (us > 1000000) AS s FROM (SELECT *, row_number() OVER "
        "(PARTITION BY worker ORDER BY ts DESC, e DESC) AS k FROM ev) WHERE k <= 100 GROUP BY 1) "
        "SELECT ev.worker, count(*) AS total_operations, count(*) FILTER (e % 17 <> 0) AS successful_operations, "
        "count(*) FILTER (e % 17 = 0) AS failed_operations, max(us) / 1e6 AS max_response_time, any_value(a) AS avg_response_time, "
        "any_value(s) AS slow_operations_count FROM ev JOIN r ON ev.worker = r.worker GROUP BY 1"
    ),
    "resource_trends": _q(
        f", t AS (SELECT host, e AS seq, CASE WHEN count(*) OVER w10 >= 3 THEN avg(cpu) OVER w3 - avg(cpu) OVER w10 END AS c, "
        f"CASE WHEN count(*) OVER w10 >= 3 THEN avg(mem) OVER w3 - avg(mem) OVER w10 END AS m FROM res "
        f"WINDOW w3 AS (PARTITION BY host ORDER BY ts, e {_LAST3}), w10 AS (PARTITION BY host ORDER BY ts, e {_LAST10})) "
        "SELECT host, seq, round(c, 6) AS cpu_trend, round(m, 6) AS memory_trend, "
        "CASE WHEN c > 10 THEN 'increasing' WHEN c < -10 THEN 'decreasing' END AS cpu_direction, "
        "CASE WHEN m > 5 THEN 'increasing' WHEN m < -5 THEN 'decreasing' END AS memory_direction, "
        "coalesce(c > 20, false) AS cpu_warning, coalesce(m > 10, false) AS memory_warning FROM t"
    ),
    "throughput_cpu_correlation": _q(
        f", k AS (SELECT host, ts, v, avg(v) OVER w AS m, count(*) OVER w AS n FROM clk WINDOW w AS (PARTITION BY host ORDER BY ts, e {_LAST3})), "
        f"c AS (SELECT host, ts, cpu, avg(cpu) OVER w AS m, count(*) OVER w AS n FROM res WINDOW w AS (PARTITION BY host ORDER BY ts, e {_LAST3})), "
        "j AS (SELECT c.host, c.ts, c.cpu, k.v, coalesce(c.n = 3 AND k.n = 3, false) AS ok, k.v > k.m AS up, c.cpu > c.m AS cup "
        "FROM c ASOF LEFT JOIN k ON c.host = k.host AND c.ts >= k.ts) "
        "SELECT host, ts, CASE WHEN ok THEN v END AS ops_per_sec, cpu AS cpu_percent, ok AND up AND cup AS correlated, "
        "ok AND NOT up AND cup AND cpu > 70 AS anomaly FROM j"
    ),
    "memory_degradation": _q(
        f", k AS (SELECT host, 'w' || (u % 6) AS worker, ts, v, avg(v) OVER w AS m, count(*) OVER w AS n FROM clk "
        f"WINDOW w AS (PARTITION BY host, u % 6 ORDER BY ts, e {_LAST3})), "
        f"c AS (SELECT host, ts, mem, avg(mem) OVER w AS m, count(*) OVER w AS n FROM res WINDOW w AS (PARTITION BY host ORDER BY ts, e {_LAST3})) "
        "SELECT k.host, k.worker, k.ts, k.v AS rate, CASE WHEN k.n = 3 AND c.n = 3 THEN c.mem END AS memory_percent, "
        "coalesce(k.n = 3 AND c.n = 3, false) AND k.v < k.m * 0.7 AND c.mem > c.m * 1.2 AS degraded "
        "FROM k ASOF LEFT JOIN c ON k.host = c.host AND k.ts >= c.ts"
    ),
    "high_throughput_mode": _q(
        "SELECT e AS seq, et AS queue, coalesce(last_value(CASE WHEN size > 800 THEN true WHEN size < 500 THEN false END IGNORE NULLS) "
        "OVER (PARTITION BY et ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS high_throughput FROM ev"
    ),
    "stalled_workers": _q(
        ", a AS (SELECT host, worker, max(ts) AS last_ts FROM ev WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1, 2) "
        "SELECT *, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_ts)) / 1e6 AS idle_seconds, "
        "(epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_ts)) / 1e6 > 1800 AS stalled FROM a"
    ),
    "outages": _q(
        ", p AS (SELECT host, ts, e, v < 60 AS up, count(*) FILTER (v < 60) OVER (PARTITION BY host ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS n, min(CASE WHEN v < 60 THEN ts END) OVER (PARTITION BY host ORDER BY ts, e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM ev) "
        "SELECT host, min(ts) AS outage_start, max(ts) AS last_skipped, any_value(nxt) AS restored_at, count(*) AS skipped_polls FROM p WHERE NOT up GROUP BY host, n"
    ),
    "history_retention": _q(
        "SELECT e AS seq, worker, ts FROM ev WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts >= TIMESTAMP '2024-01-27 12:00:00' "
        "ORDER BY ts DESC, e DESC LIMIT 500"
    ),
    "queue_fill_severity": _q(
        "SELECT e AS seq, CASE WHEN size > 900 THEN 'error' WHEN size > 700 THEN 'warning' ELSE 'info' END AS severity FROM ev"
    ),
    "slow_alert_severity": _q(
        "SELECT e AS seq, CASE WHEN us / 1e6 * 3 > 10 THEN 'critical' WHEN us / 1e6 * 3 > 5 THEN 'very_slow' WHEN us / 1e6 * 3 > 1 THEN 'slow' END AS severity FROM ev"
    ),
    "immediate_alerts": _q(
        "SELECT e AS event_id, CASE e % 4 WHEN 0 THEN 'worker_performance' WHEN 2 THEN 'kafka_performance' ELSE 'service_performance' END AS event_type "
        "FROM ev WHERE (e % 4 = 0 AND e % 3 > 0 AND v / 8 > 5) OR (e % 4 = 2 AND v / 10 > 5) OR (e % 4 = 3 AND (v / 15 > 10 OR v / 60 > 2))"
    ),
    "event_routing": _q(
        "SELECT CASE e % 4 WHEN 0 THEN 'worker_performance' WHEN 1 THEN 'worker_last_processed' WHEN 2 THEN 'kafka_performance' ELSE 'unknown' END AS route, "
        "count(*) AS events FROM ev GROUP BY 1"
    ),
    "worker_status": _q(
        "SELECT e AS event_id, CASE WHEN e % 4 <> 0 AND e % 90 > 60 THEN 'STALLED' WHEN v - 5 <= 0 THEN 'IDLE' "
        "WHEN e % 50 > 0 AND (e % 9)::DOUBLE / (e % 50) * 100 > 20 THEN 'STALLED' WHEN v / 40 > 2 OR v / 10 > 10 THEN 'STALLED' ELSE 'ACTIVE' END AS status FROM ev"
    ),
    "queue_status": _q(
        "SELECT e AS seq, CASE WHEN size >= 900 THEN 'CRITICAL' WHEN size >= 700 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM ev"
    ),
    "service_status": _q(
        "SELECT e AS event_id, CASE WHEN e % 13 = 0 THEN 'CRITICAL' WHEN e % 3 <> 0 AND e % 11 = 0 THEN 'CRITICAL' WHEN e % 4 <> 0 AND v / 10 >= 15 THEN 'CRITICAL' "
        "WHEN e % 4 <> 0 AND v / 10 >= 5 THEN 'DEGRADED' WHEN e % 5 = 0 AND e % 2 = 0 AND v / 20 >= 5 THEN 'CRITICAL' "
        "WHEN e % 5 = 0 AND e % 2 = 0 AND v / 20 >= 1 THEN 'DEGRADED' WHEN e % 6 = 0 AND v > 30 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM ev"
    ),
    "system_status": _q(f"SELECT e AS seq, {_SYSTEM} AS status FROM res"),
    "overall_status": _q("SELECT snapshot_id, overall_status, round(health_score, 6) AS health_score FROM ov"),
    "queue_health": _q(
        "SELECT e AS seq, size::DOUBLE / 1000 * 100 AS utilization_percentage, CASE WHEN size::DOUBLE / 1000 * 100 > 90 THEN 'CRITICAL' "
        "WHEN size::DOUBLE / 1000 * 100 > 70 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, size::DOUBLE / 1000 * 100 <= 70 AS is_healthy, "
        "CASE WHEN size::DOUBLE / 1000 * 100 >= 90 THEN 'CRITICAL' WHEN size::DOUBLE / 1000 * 100 >= 70 THEN 'WARNING' ELSE 'LOW' END AS risk_level FROM ev"
    ),
    "worker_health": _q(
        "SELECT e AS event_id, e % 3 <> 0 AS alive, e % 7 AS slow_alerts, e % 50 AS alerts_processed, CASE WHEN e % 3 <> 0 THEN 'ACTIVE' ELSE 'STALLED' END AS status, "
        "CASE WHEN e % 3 <> 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS health_score, e % 3 <> 0 AS is_healthy, "
        "round((e % 7)::DOUBLE / greatest(e % 50, 1) * 100, 6) AS slow_percentage FROM ev"
    ),
    "system_health": _q(
        "SELECT e AS seq, cpu < 80 AND mem < 85 AND e % 6 <> 0 AS is_healthy, CASE WHEN cpu > 90 OR mem > 95 THEN 'HIGH' WHEN cpu > 70 OR mem > 80 THEN 'MEDIUM' "
        "ELSE 'LOW' END AS resource_pressure FROM res"
    ),
    "queue_summary": _q(
        "SELECT date_trunc('day', ts) AS day, count(*) AS total_queues, count(*) FILTER (size <= 700) AS healthy_queues, sum(size)::BIGINT AS total_pending, "
        "round(sum(size)::DOUBLE / count(*) / 10, 6) AS average_utilization, CASE WHEN count(*) FILTER (size > 700) = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM ev GROUP BY 1"
    ),
    "worker_summary": _q(
        "SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (e % 3 <> 0) AS healthy, count(*) FILTER (e % 4 = 0) AS processing FROM ev GROUP BY 1"
    ),
    "component_summary": _q(
        "SELECT snapshot_id, " + ", ".join(
            f"count(*) FILTER (kind = '{k}' AND ok) AS healthy_{k}s, count(*) FILTER (kind = '{k}') AS total_{k}s" for k in ("worker", "queue", "service")
        ) + ", coalesce(bool_and(ok) FILTER (kind = 'system'), false) AS system_healthy FROM ch GROUP BY 1"
    ),
    "quick_status": _q(
        ", q AS (SELECT snapshot_id, count(*) FILTER (kind = 'worker') AS total_workers, count(*) FILTER (kind = 'service') AS total_services, "
        "count(*) FILTER (kind = 'worker' AND ok) AS healthy_workers, count(*) FILTER (kind = 'service' AND ok) AS healthy_services FROM ch GROUP BY 1) "
        "SELECT *, CASE WHEN (total_workers > 0 AND healthy_workers = 0) OR (total_services > 0 AND healthy_services = 0) THEN 'CRITICAL' "
        "WHEN healthy_workers < total_workers OR healthy_services < total_services THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM q"
    ),
    "readiness": _q(
        "SELECT snapshot_id, overall_status, nw > 0 AS workers_available, coalesce(sys_ok, false) AS system_healthy, "
        "overall_status <> 'CRITICAL' AND nw > 0 AS ready FROM ov"
    ),
    "detailed_report": _q(
        ", k AS (SELECT unnest(['system', 'worker', 'queue', 'service']) AS section), sn AS (SELECT DISTINCT snapshot_id FROM ch) "
        "SELECT sn.snapshot_id, k.section, '' AS name, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status, "
        "count(ch.e) AS total, CASE WHEN k.section = 'worker' THEN count(*) FILTER (ch.status = 'ACTIVE') END AS active, NULL::VARCHAR AS detail, NULL::DOUBLE AS health_score "
        "FROM sn JOIN k ON true LEFT JOIN ch ON ch.snapshot_id = sn.snapshot_id AND ch.kind = k.section GROUP BY 1, 2 UNION ALL "
        "SELECT snapshot_id, kind, name, status, NULL, NULL, '{\"id\": ' || e || '}', NULL FROM ch UNION ALL "
        "SELECT snapshot_id, 'snapshot', '', overall_status, NULL, NULL, NULL, round(health_score, 6) FROM ov"
    ),
    "prometheus_lines": _prometheus(),
    "row_validation": _q(
        "SELECT e AS event_id, concat_ws(',', CASE WHEN e % 31 = 0 THEN 'queue_name' END, CASE WHEN e % 40 - 1 < 0 THEN 'current_size' END, "
        "CASE WHEN v > 100 THEN 'utilization_percentage' END, CASE WHEN e - 50 < 0 THEN 'total_processed' END, "
        "CASE WHEN v - 1 < 0 THEN 'avg_wait_time' END) AS violations FROM ev"
    ),
    "worker_validation": _q(
        "SELECT e AS event_id, concat_ws(',', CASE WHEN e % 31 = 0 THEN 'worker_name' END, CASE WHEN e % 40 = 0 THEN 'alerts_processed' END, "
        "CASE WHEN v < 1 THEN 'recent_avg_processing_time' END, "
        "CASE WHEN e % 50 < 2 THEN 'extremely_slow_alerts_count' END, CASE WHEN e % 7 = 0 THEN 'last_alert_id' END, "
        "CASE WHEN v > 100 THEN 'health_score' END) AS violations FROM ev"
    ),
    "system_validation": _q(
        "SELECT e AS event_id, concat_ws(',', CASE WHEN e % 20 = 0 THEN 'process_id' END, CASE WHEN e % 31 = 0 THEN 'process_name' END, "
        "CASE WHEN v > 100 THEN 'cpu_percent' END, CASE WHEN e % 120 > 100 THEN 'memory_percent' END, "
        "CASE WHEN v < 1 THEN 'memory_usage_mb' END, CASE WHEN e % 9 = 0 THEN 'max_open_files' END, "
        "CASE WHEN e % 13 = 0 THEN 'threads_count' END) AS violations FROM ev"
    ),
    "service_validation": _q(
        "SELECT e AS event_id, concat_ws(',', CASE WHEN e % 31 = 0 THEN 'service_name' END, CASE WHEN e % 6 = 0 THEN 'is_healthy' END, "
        "CASE WHEN e % 5 = 0 THEN 'status' END) AS violations FROM ev"
    ),
    "snapshot_validation": _q(
        "SELECT e AS event_id, concat_ws(',', CASE WHEN v < 5 OR v > 105 THEN 'health_score' END) AS violations FROM ev"
    ),
    "slow_alert_quarantine": _q(
        "SELECT e AS seq, 'a' || e AS alert_id, 'slow_processing' AS reason FROM ev WHERE us > 3000000"
    ),
    "worker_intervals": _q(
        "SELECT worker, half AS interval_start, count(*) AS alerts_processed, sum(us)::BIGINT AS total_us, "
        "count(*) FILTER (us > 2000000 AND us <= 5000000) AS slow_alerts, last('a' || e ORDER BY ts, e) AS last_alert_id, "
        "round(count(*) / 43200.0::DOUBLE, 6) AS rate FROM ev GROUP BY 1, 2"
    ),
    "rate_limit": _RATE_LIMIT,
    "sender_intervals": (
        "WITH l AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 's' || l_suppkey END AS sender, date_trunc('day', l_shipdate) AS d, l_shipdate AS ts, "
        "(l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, round(l_extendedprice * 50)::BIGINT AS us FROM lineitem) "
        "SELECT sender, d::TIMESTAMP AS interval_start, count(*) AS operations, count(*) FILTER (us > 1000000) AS slow_operations, max(us) AS max_us, "
        "max(us) FILTER (us > 1000000) AS slow_max_us, first(us & 1023 ORDER BY us DESC, ts, seq) AS max_prep_us, "
        "round(count(*) / 86400.0::DOUBLE, 9) AS ops_per_sec, round(count(*) FILTER (us > 1000000)::DOUBLE / count(*) * 100, 9) AS slow_pct FROM l GROUP BY 1, 2"
    ),
}

# Intervals that the watermark has closed, and those still open.
INTERVAL_STREAM = _q("SELECT topic, interval_start, operations, slow_operations, max_us FROM iv")
