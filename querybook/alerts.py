"""Queries over alert lines: ingest, relevance, messages, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import json_text, net, xmltext
from alertloom.operators import delivery, dispatch, ingest, requests, syslog, windows
from alertloom.plans import alert_plan
from alertloom.plans.alert_plan import AlertJob
from querybook import inputs

KEYS = ["event_id"]
OWN_NETWORK = "8.8.8.0/25"
ALLOWED = ["10.0.0.0/9", "192.168.128.0/17", "2001:db8::8/125", "127.0.0.1"]


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_lines(inputs.alert_lines(spark, sf))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.accepted(_parsed(spark, sf))


def _outcomes(spark: SparkSession, sf: str, own_network: str | None = None) -> DataFrame:
    return dispatch.outcomes(_alerts(spark, sf), own_network, KEYS)


def _messages(spark: SparkSession, sf: str, branch: str | None = None) -> DataFrame:
    rows = dispatch.messages(_outcomes(spark, sf))
    return rows.where(F.col("branch") == branch) if branch else rows


def alert_framing(spark, sf):
    lines = inputs.alert_lines(spark, sf).withColumn("whole", F.length("line"))
    framed = ingest.frame(lines)
    return framed.select(
        "event_id", F.startswith("line", F.lit('{"timestamp"')).alias("framed"),
        (F.col("whole") - F.length("line")).cast("bigint").alias("cut"),
    )


def line_size_guard(spark, sf):
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("line"))
    return ingest.size_guard(lines, 2000).select("doc_id", "oversize")


def text_repair(spark, sf):
    return ingest.decode(ingest.frame(inputs.alert_lines(spark, sf))).select(
        "event_id", "replaced", F.contains("text", F.lit("�")).alias("has_replacement")
    )


def strict_parse(spark, sf):
    return _parsed(spark, sf).select(
        "event_id", "reason", "replaced", json_text.text_at(F.col("alert"), "$.id").alias("alert_id"),
        json_text.text_at(F.col("alert"), "$.agent.name").alias("agent_name"),
    )


def quarantine_records(spark, sf):
    return ingest.quarantine(_parsed(spark, sf)).select(
        "event_id", "reason", (F.length("raw") > 0).alias("has_raw"), F.col("replaced_text").isNotNull().alias("repaired")
    )


def quarantine_retention(spark, sf):
    stored = ingest.quarantine(_parsed(spark, sf)).select("event_id", "ts", "reason")
    return ingest.retain_newest(stored, ["ts", "event_id"], 100)


def ingest_stats(spark, sf):
    rows = ingest.ingest_stats(_parsed(spark, sf), "ts", "3600 seconds", 3600)
    return rows.withColumn("alerts_per_second", F.round("alerts_per_second", 9)).withColumn(
        "error_rate", F.round("error_rate", 6)
    )


def keep_latest(spark, sf):
    arrivals = inputs.events(spark, sf).select("event_id", "ts", "event_type")
    return ingest.keep_latest(arrivals, ["ts", "event_id"], 3000)


def keep_latest_per_source(spark, sf):
    arrivals = inputs.events(spark, sf).select("event_id", "ts", "event_type")
    return ingest.keep_latest(arrivals, ["ts", "event_id"], 1200, ["event_type"])


def discarded_counts(spark, sf):
    return ingest.discarded_counts(inputs.events(spark, sf), 1200, ["event_type"])


def relevance_counts(spark, sf):
    return dispatch.relevance_counts(_outcomes(spark, sf))


def windows_relevance(spark, sf):
    rows = dispatch.with_relevance(_alerts(spark, sf)).where("is_windows")
    event_id = json_text.text_at(F.col("alert"), f"{windows.SYSTEM}.eventID")
    return rows.select("event_id", event_id.alias("windows_id"))


def fail2ban_relevance(spark, sf):
    rows = dispatch.with_relevance(_alerts(spark, sf)).where("is_fail2ban")
    return rows.select("event_id", json_text.text_at(F.col("alert"), "$.data.srcip").alias("srcip"))


def alert_relevance(spark, sf):
    return dispatch.with_relevance(_alerts(spark, sf)).select("event_id", "is_windows", "is_fail2ban", "is_relevant")


def global_addresses(spark, sf):
    address = inputs.source_address(F.col("event_id"))
    return inputs.events(spark, sf).select("event_id", net.is_global(address, OWN_NETWORK).alias("is_global"))


def own_network_filter(spark, sf):
    rows = _outcomes(spark, sf, OWN_NETWORK).where(F.col("branch") == dispatch.FAIL2BAN)
    return rows.select("event_id", "drop_reason")


def network_allowlist(spark, sf):
    return requests.allowlisted(inputs.access_log(spark, sf), ALLOWED).select("request_id", "client", "allowed")


def network_allowlist_table(spark, sf):
    log = inputs.access_log(spark, sf).select("request_id", "peer")
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    key = F.col("s_suppkey")
    network = F.concat_ws(".", F.lit("10"), (key % 256).cast("string"), F.lit("0"), ((key * 16) % 256).cast("string"))
    networks = supplier.select(F.concat(network, F.lit("/28")).alias("network"))
    return requests.allowed_by_table(log, networks, "peer").select("request_id", "allowed")


def network_allowlist_mixed(spark, sf):
    """A table of networks of both families: by mask, by prefix length, by host mask, and unreadable ones."""
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    network = (
        F.when(k % 5 == 0, text("10.", k % 256, ".0.0/255.255.255.0"))
        .when(k % 5 == 1, text("10.", k % 256, ".0.", (k * 16) % 256, "/28"))
        .when(k % 5 == 2, text("2001:DB8::0:", k % 10, "/127"))
        .when(k % 5 == 3, text("192.168.", k % 256, ".7/0.0.0.255"))
        .otherwise(text("10.", k % 256, ".0.0/", F.when(k % 2 == 0, "abc").otherwise("255.0.255.0")))
    )
    networks = spark.read.parquet(f"{sf}/supplier.parquet").select(network.alias("network"))
    log = inputs.access_log(spark, sf)
    address = requests.client_address(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return requests.allowed_by_table(log.select("request_id", address.alias("client")), networks, "client")


def _windows_rows(spark, sf):
    alert = F.col("alert")
    rows = dispatch.with_relevance(_alerts(spark, sf)).where("is_windows")
    data = F.from_json(windows.data_text(F.col("text")), windows.DATA_SCHEMA)
    return rows.select("event_id", windows.fields(alert).alias("w"), data.alias("d"))


def windows_system_xml(spark, sf):
    rows = _windows_rows(spark, sf).select("event_id", windows.system_xml(F.col("w")).alias("xml"))
    return rows.where(F.col("xml").isNotNull())


def event_data_xml(spark, sf):
    w = F.col("w")
    rows = _windows_rows(spark, sf).where(~w["eventID"].isin("1100", "1102") & w["eventdata_kind"].isNotNull())
    items = windows.event_data_items(F.col("d.win.eventdata"), w["eventID"])
    rows = rows.withColumn("items", items)
    return rows.select("event_id", xmltext.container("EventData", F.col("items")).alias("xml"))


def shutdown_user_data(spark, sf):
    rows = _windows_rows(spark, sf).where(F.col("w.eventID") == "1100")
    return rows.select("event_id", windows.data_xml(F.col("w"), F.lit(None).cast("string")).alias("xml"))


def log_cleared_user_data(spark, sf):
    rows = _windows_rows(spark, sf).where(F.col("w.eventID") == "1102")
    rows = rows.withColumn("items", windows.log_cleared_items(F.col("d.win.logFileCleared")))
    return rows.select("event_id", windows.data_xml(F.col("w"), F.col("items")).alias("xml"))


def xml_escaping(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select(
        "page_id", xmltext.element("Text", F.col("html")).alias("as_text"),
        xmltext.attributes(Name=F.col("url"), Html=F.col("html")).alias("as_attributes"),
    )


def windows_messages(spark, sf):
    m = F.col("message")
    return _messages(spark, sf, dispatch.WINDOWS).select(
        "event_id", m["timestamp"].alias("sent_timestamp"), m["event_format"].alias("event_format"),
        m["event_forward"].alias("event_forward"), m["event_source"].alias("event_source"),
        m["event_raw"].alias("event_raw"), (m["body"] == m["event_raw"]).alias("same_body"), m["data"].alias("data"),
    )


def windows_rejections(spark, sf):
    rows = dispatch.rejected(_outcomes(spark, sf)).where(F.col("branch") == dispatch.WINDOWS)
    return rows.select("event_id", "drop_reason")


def syslog_severity(spark, sf):
    rows = dispatch.with_relevance(_alerts(spark, sf)).where("is_fail2ban").withColumn("s", syslog.fields(F.col("alert")))
    number = syslog.severity(F.col("s"))
    return rows.select("event_id", number.alias("severity"), syslog.priority(number).alias("priority"))


def syslog_event_raw(spark, sf):
    m = F.col("message")
    return _messages(spark, sf, dispatch.FAIL2BAN).select("event_id", m["event_raw"].alias("event_raw"), m["body"].alias("body"))


def syslog_messages(spark, sf):
    m = F.col("message")
    return _messages(spark, sf, dispatch.FAIL2BAN).select(
        "event_id", m["timestamp"].alias("sent_timestamp"), *[
            m[c].alias(c) for c in ("event_format", "hostName", "structuredData", "appName", "appInst", "procId",
                                    "facility", "priority", "severity")
        ],
    )


def message_dispatch(spark, sf):
    m = F.col("message")
    return _messages(spark, sf).select("event_id", "branch", m["event_format"].alias("event_format"), F.length(m["body"]).cast("bigint").alias("body_chars"))


def client_address(spark, sf):
    log = inputs.access_log(spark, sf)
    address = requests.client_address(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return log.select("request_id", address.alias("client"))


def message_values(spark, sf):
    return _messages(spark, sf).select("event_id", delivery.encode(F.col("message")).alias("value"))


def kafka_records(spark, sf):
    rows = delivery.kafka_records(_messages(spark, sf), "customer-1", KEYS)
    return rows.select("event_id", "topic", F.get_json_object("value", "$.event_raw").alias("event_raw"))


def acknowledgements(spark, sf):
    return delivery.acknowledgements(_messages(spark, sf), keep=KEYS).drop("line", "oversize")


def ack_lines(spark, sf):
    return delivery.acknowledgements(_messages(spark, sf), keep=KEYS).select("event_id", "line")


def oversize_acks(spark, sf):
    rows = delivery.acknowledgements(_messages(spark, sf), keep=KEYS)
    return rows.select("event_id", delivery.oversize_line(F.col("line"), 190).alias("oversize"))


def incident_errors(spark, sf):
    return delivery.incident_rows(_messages(spark, sf), KEYS).select("event_id", "description", "line")


def outgoing_records(spark, sf):
    rows = alert_plan.records(inputs.alert_lines(spark, sf), AlertJob("customer-1", OWN_NETWORK), KEYS)
    return rows.select("event_id", "stream", "branch", "reason")


QUERIES = [
    alert_framing, line_size_guard, text_repair, strict_parse, quarantine_records, quarantine_retention, ingest_stats,
    keep_latest, keep_latest_per_source, discarded_counts, relevance_counts, windows_relevance, fail2ban_relevance,
    alert_relevance, global_addresses, own_network_filter, network_allowlist, network_allowlist_table, network_allowlist_mixed,
    windows_system_xml, event_data_xml, shutdown_user_data, log_cleared_user_data, xml_escaping, windows_messages,
    windows_rejections, syslog_severity, syslog_event_raw, syslog_messages, message_dispatch, client_address,
    message_values, kafka_records, acknowledgements, ack_lines, oversize_acks,
    incident_errors, outgoing_records,
]
