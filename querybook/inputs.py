"""Operator inputs that Spark derives from the test tables.

None of the tables is an alert log, so alert lines, telemetry, snapshots and
request logs are spelled from whole tables here; the queries then run the real
operators on them.  The expected results in ``alerts_expected.py`` and
``telemetry_expected.py`` are computed from the table columns, not from these texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text
from alertloom.session import configure


# Rows of one task at most, on average.  Some operators sort the rows of a task, which takes memory for all of them.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, spread over the cores if it has fewer files than there are cores.

    Small tables are one file each and would be worked on by a single task; a
    large table is spread over as many tasks as ``TASK_ROWS`` asks for, or read
    as it is stored if that makes as many.
    """
    rows = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    wanted = -(-rows.count() // TASK_ROWS)
    few = len(rows.inputFiles()) < cores or cores < wanted and rows.rdd.getNumPartitions() < wanted
    return rows.repartition(max(cores, wanted)) if few else rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _windows_data() -> Column:
    e, u = F.col("event_id"), F.col("user_id")
    ids = F.array(*[F.lit(i) for i in fixed.MONITORED_EVENT_IDS])
    monitored = F.get(ids, (e % 13).cast("int"))
    event_id = F.when(F.col("event_type") == "error", monitored).otherwise("4624")
    id_text = F.when(e % 97 == 5, event_id).otherwise(_text('"', event_id, '"'))
    provider = F.when(e % 29 == 0, "").otherwise('"providerName":"Audit & \\"Co\\"",')
    system = _text(
        '"system":{', provider, '"providerGuid":"{g-', e % 7, '}","eventID":', id_text,
        ',"version":"0","level":"4","opcode":"","keywords":"0x80<1>","systemTime":"', _iso(), 'Z","eventRecordID":"',
        e, '","processID":"', e % 1000, '","threadID":"1\\t2","channel":"Security","computer":"host', u, '.example"}',
    )
    address = F.when(e % 3 == 0, "").otherwise(_text(',"ipAddress":"198.51.100.', e % 256, '","ipPort":"', e % 65536, '"'))
    eventdata = _text('"eventdata":{"targetUserName":"user', u, '","note":"a & b < c > \\"d\\"","empty":""', address, "}")
    cleared = _text('"logFileCleared":{"subjectUserName":"user', u, '","clientProcessId":"', e % 1000, '"}')
    part = F.when(e % 11 == 0, "").when(event_id == "1102", _text(",", cleared)).otherwise(_text(",", eventdata))
    return _text('{"win":{', system, part, "}}")


SOURCES = ("8.8.8.{n}", "10.0.0.{n}", "192.0.2.{n}", "100.64.1.{n}", "224.0.0.{n}", "2001:4860::{n}", "fe80::{n}", "bad", "")


def source_address(e: Column) -> Column:
    """A mix of global, private, shared, multicast, IPv6, unreadable and empty addresses."""
    choices = F.array(*[F.lit(s) for s in SOURCES])
    return F.replace(F.get(choices, (e % len(SOURCES)).cast("int")), F.lit("{n}"), (e % 200).cast("string"))


def _syslog_data() -> Column:
    e = F.col("event_id")
    program = (
        F.when(F.col("event_type") == "click", "fail2ban.actions")
        .when(F.col("event_type") == "view", "fail2ban.filter")
        .otherwise("sshd")
    )
    words = F.array(F.lit("NOTICE"), F.lit("WARNING"), F.lit("ERROR"), F.lit("INFO"))
    severity = F.when(e % 5 == 4, "").otherwise(_text('"severity":"', F.get(words, (e % 5).cast("int")), '",'))
    pid = F.when(e % 4 == 0, "").otherwise(_text(',"pid":"', e % 5000, '"'))
    return _text("{", severity, '"srcip":"', source_address(e), '","program_name":"', program, '"', pid, "}")


def _full_log() -> Column:
    e = F.col("event_id")
    words = F.array(F.lit("NOTICE"), F.lit("WARNING"), F.lit("ERROR"), F.lit("INFO"))
    word = F.coalesce(F.get(words, (e % 5).cast("int")), F.lit("NONE"))
    head = F.when(e % 2 == 0, "fail2ban: ").otherwise("")
    return _text(head, "12:00:00,000 [", e % 5000, "]: ", word, " [sshd] Ban ", e % 256)


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream."""
    schema = configure(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(events(spark, sf_dir))


def lines_of(rows: DataFrame) -> DataFrame:
    """One alert line per event; some of every 97 are broken in one of several ways."""
    e, u = F.col("event_id"), F.col("user_id")
    is_windows = F.col("event_type").isin("error", "signup")
    bad_byte = F.when(e % 97 == 8, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    agent = F.concat(
        F.lit(b'"agent":{"id":"'), _text(u % 1000).cast("binary"), F.lit(b'","name":"host'),
        _text(u).cast("binary"), bad_byte, F.lit(b'","ip":"10.1.0.'), _text(u % 250).cast("binary"), F.lit(b'"}'),
    )
    group = F.when(is_windows, "windows").otherwise("fail2ban")
    body = _text(
        ',"rule":{"level":5,"groups":["syslog","', group, '"]},"full_log":"', _full_log(), '","data":',
        F.when(is_windows, _windows_data()).otherwise(_syslog_data()),
    )
    head = _text('{"timestamp":"', _iso(), '+0000","id":"', e, '",').cast("binary")
    again = F.when(e % 97 == 4, _text(',"id":"again-', e, '"')).otherwise("")
    whole = F.concat(head, agent, _text(body, again, "}").cast("binary"))
    line = (
        F.when(e % 97 == 0, F.concat(whole, F.lit(b" trailing")))
        .when(e % 97 == 1, F.concat(F.lit(b"leading "), whole))
        .when(e % 97 == 2, F.concat(head, F.lit(b'"agent":{"id":"')))
        .when(e % 97 == 3, F.concat(whole, F.lit(b"]")))
        .when(e % 97 == 6, _text('{"id":"', e, '"}').cast("binary"))
        .otherwise(whole)
    )
    # Generated once per row; a filter on the line must not spell it a second time.
    return rows.select("event_id", "ts", "user_id", json_text.once(line=line.cast("string")))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing times of alerts: host, worker, ts, seq, alert_id, elapsed_us, success."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        _text("h", u % 3).alias("host"),
        _text("w", u % 10).alias("worker"),
        "ts",
        e.alias("seq"),
        _text("a", e).alias("alert_id"),
        elapsed_us().alias("elapsed_us"),
        (e % 17 != 0).alias("success"),
    )


def elapsed_us() -> Column:
    return F.round(F.col("value") * 100).cast("bigint") * 125


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations_of(events(spark, sf_dir))


def operations_of(rows: DataFrame) -> DataFrame:
    """Sink operations: topic, ts, seq, elapsed_us and its stages."""
    e = F.col("event_id")
    us = elapsed_us()
    part = lambda k: F.floor(us * ((e % k) + 1) / 40).cast("bigint")
    prep, encode, send = part(5), part(7), part(29)
    usual = F.create_map(F.lit("prep"), prep, F.lit("encode"), encode, F.lit("send"), send)
    first = F.map_concat(usual, F.create_map(F.lit("connect"), part(23)))
    return rows.select(
        F.col("event_type").alias("topic"), "ts", e.alias("seq"), us.alias("elapsed_us"),
        F.when(e % 5 == 0, first).otherwise(usual).alias("stages"),
    )


def queue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill levels of queues: queue, ts, seq, size, capacity, processed."""
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("queue"), "ts", e.alias("seq"), ((e * 7919) % 1001).alias("size"),
        F.lit(1000).cast("bigint").alias("capacity"), (e % 5 + 1).alias("processed"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host samples: host, ts, seq, cpu_percent, memory_percent."""
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        _text("h", F.col("user_id") % 3).alias("host"), "ts", e.alias("seq"),
        ((e * 37) % 1000 / 10.0).alias("cpu_percent"), ((e * 53) % 1000 / 10.0).alias("memory_percent"),
    )


def sink_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput samples of the same hosts: host, ts, seq, ops_per_sec."""
    rows = events(spark, sf_dir).where(F.col("event_type") == "click")
    return rows.select(
        _text("h", F.col("user_id") % 3).alias("host"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("ops_per_sec"),
    )


def worker_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of workers: host, worker, ts, seq, rate."""
    rows = events(spark, sf_dir).where(F.col("event_type") == "click")
    return rows.select(
        _text("h", F.col("user_id") % 3).alias("host"), _text("w", F.col("user_id") % 6).alias("worker"), "ts",
        F.col("event_id").alias("seq"), F.col("value").alias("rate"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection polls: host, ts, seq, connected."""
    return events(spark, sf_dir).select(
        _text("h", F.col("user_id") % 3).alias("host"), "ts", F.col("event_id").alias("seq"),
        (F.col("value") < 60).alias("connected"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows of snapshots: eight events make one snapshot with one system row."""
    e = F.col("event_id")
    slot = e % 8
    kind = F.when(slot == 0, "system").when(slot <= 3, "worker").when(slot <= 5, "queue").otherwise("service")
    bad = F.col("value") > 140
    poor = F.col("value") > 90
    status = (
        F.when(kind == "worker", F.when(poor, "STALLED").when(F.col("value") < 3, "IDLE").otherwise("ACTIVE"))
        .when(bad, "CRITICAL").when(poor, "DEGRADED").otherwise("HEALTHY")
    )
    rows = events(spark, sf_dir).select(
        F.floor(e / 8).alias("snapshot_id"), kind.alias("kind"), _text(kind, "-", slot).alias("name"),
        status.alias("status"), "value", e.alias("event_id"),
    )
    return rows.withColumn("is_healthy", F.col("status").isin("HEALTHY", "ACTIVE")).withColumn(
        "detail", _text('{"id": ', F.col("event_id"), "}")
    )


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with the value fields of the exposition, and a snapshot row."""
    e = F.col("event_id")
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    base = components(spark, sf_dir).select(
        "snapshot_id", "kind", "name", "status", "value", "event_id",
        of("service", F.when(e % 2 == 0, "kafka")).alias("service_type"),
        of("system", e % 101 / 1.0).alias("cpu_percent"),
        of("system", e % 89 / 1.0).alias("memory_percent"),
        of("system", F.col("value")).alias("memory_usage_mb"),
        of("system", e * 1.5).alias("uptime_seconds"),
        of("system", e % 300).alias("open_files_count"),
        of("system", e % 30 + 1).alias("threads_count"),
        of("worker", e % 1000).alias("alerts_processed"),
        of("worker", F.col("value")).alias("processing_rate"),
        of("worker", F.when(F.col("status") == "ACTIVE", 0.8).otherwise(0.2)).alias("health_score"),
        of("queue", e % 500).alias("current_size"),
        of("queue", e % 500 / 8.0).alias("utilization_percentage"),
        of("queue", e).alias("total_processed"),
        of("service", e % 3 != 0).alias("is_connected"),
        of("service", F.when(e % 4 != 0, e)).alias("total_operations"),
        of("service", F.when(e % 4 != 0, F.col("value"))).alias("error_rate"),
        F.lit(None).cast("string").alias("overall_status"),
    )
    return base


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(events(spark, sf_dir))


def requests_of(rows: DataFrame) -> DataFrame:
    """Request log: a third of all requests come from one client."""
    e, u = F.col("event_id"), F.col("user_id")
    return rows.select(
        e.alias("request_id"), F.col("ts").alias("request_ts"),
        F.when(e % 3 == 0, "hot").otherwise(_text("c", u)).alias("client"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with peer and forwarding headers."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        e.alias("request_id"),
        F.when(e % 7 == 0, "").otherwise(_text("10.", u % 256, ".0.", e % 256)).alias("peer"),
        F.when(e % 5 == 0, _text(" 192.168.", u % 256, ".", e % 256, " , 10.9.9.9")).when(e % 5 == 1, "").alias(
            "x_forwarded_for"
        ),
        F.when(e % 3 == 0, _text(" 2001:db8::", e % 10, " ")).when(e % 3 == 1, "").alias("x_real_ip"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service samples with absent fields."""
    e, v = F.col("event_id"), F.col("value")
    return events(spark, sf_dir).select(
        "event_id", (e % 13 != 0).alias("is_healthy"), F.when(e % 3 != 0, e % 11 != 0).alias("is_connected"),
        F.when(e % 4 != 0, v / 10).alias("error_rate"),
        F.when(e % 5 == 0, "kafka").when(e % 5 == 1, "socket").alias("service_type"),
        F.when(e % 2 == 0, v / 20).alias("avg_response"), F.when(e % 6 == 0, v).alias("latency"),
    )


def line_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger table as sink operations: supplier as sender, ship date as time."""
    rows = table(spark, sf_dir, "lineitem")
    us = F.round(F.col("l_extendedprice") * 50).cast("bigint")
    return rows.select(
        F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(_text("s", F.col("l_suppkey"))).alias("sender"),
        F.col("l_shipdate").alias("ts"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"),
        us.alias("elapsed_us"),
        F.create_map(F.lit("prep"), us.bitwiseAND(F.lit(1023)), F.lit("send"), us).alias("stages"),
    )
