"""Outgoing records: Kafka values, acknowledgement lines, error rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text as jt
from alertloom.functions.bind import let

# Producer settings: name in the job configuration -> Kafka option, default value.
PRODUCER_OPTIONS = {
    "request_timeout_ms": ("kafka.request.timeout.ms", "60000"),
    "retry_backoff_ms": ("kafka.retry.backoff.ms", "5000"),
    "linger_ms": ("kafka.linger.ms", "5"),
    "max_batch_size": ("kafka.batch.size", "16384"),
    "acks": ("kafka.acks", "1"),
    "max_request_size": ("kafka.max.request.size", "1048576"),
    "compression_type": ("kafka.compression.type", "gzip"),
    "client_id": ("kafka.client.id", None),
    "metadata_max_age_ms": ("kafka.metadata.max.age.ms", None),
    "connections_max_idle_ms": ("kafka.connections.max.idle.ms", None),
    "max_in_flight_requests_per_connection": ("kafka.max.in.flight.requests.per.connection", None),
    "security_protocol": ("kafka.security.protocol", None),
}


def kafka_options(
    servers: str,
    topic: str,
    *,
    keystore: str | None = None,
    truststore: str | None = None,
    overrides: Mapping[str, object] | None = None,
) -> dict[str, str]:
    """Options for ``df.write.format("kafka")``; unknown override names are ignored."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    options |= {option: default for option, default in PRODUCER_OPTIONS.values() if default is not None}
    if keystore:
        options |= {"kafka.security.protocol": "SSL", "kafka.ssl.keystore.location": keystore}
    if truststore:
        options["kafka.ssl.truststore.location"] = truststore
    for name, value in (overrides or {}).items():
        if name in PRODUCER_OPTIONS:
            options[PRODUCER_OPTIONS[name][0]] = str(value)
    return options


def encode(message: Column) -> Column:
    """Message struct as JSON text; absent fields are left out, ``data`` keeps its key order."""
    plain = F.to_json(message.dropFields("data"))
    with_data = F.concat(
        F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit(',"data":'), message["data"], F.lit("}")
    )
    return F.when(message["data"].isNotNull(), with_data).otherwise(plain)


def kafka_records(messages: DataFrame, topic: str, keep: list[str] | None = None) -> DataFrame:
    """``(topic, value)`` rows for the Kafka sink, no key."""
    return messages.select(*(keep or []), F.lit(topic).alias("topic"), encode(F.col("message")).alias("value"))


def _framed(body: Column, integration: str) -> Column:
    return F.concat(F.lit(f"1:{integration}:"), body)


def ack_line(
    body: Column, agent_id: Column, agent_name: Column, agent_ip: Column, integration: str = fixed.ACK_INTEGRATION
) -> Column:
    """Text frame of an acknowledgement, with the agent as location if it is known."""
    location = F.concat(F.lit("["), agent_id, F.lit("] ("), agent_name, F.lit(") "), agent_ip)
    location = F.replace(F.replace(location, F.lit("|"), F.lit("||")), F.lit(":"), F.lit("|:"))
    known = F.coalesce((agent_id != "") & (agent_name != ""), F.lit(False))
    return F.when(known, F.concat(F.lit("1:"), location, F.lit(f"->{integration}:"), body)).otherwise(
        _framed(body, integration)
    )


def ack_body(origin: Column, event_format: Column, integration: str = fixed.ACK_INTEGRATION) -> Column:
    """JSON text of an acknowledgement from the identity of its alert."""
    o = origin
    texts = F.array(
        event_format, o["event_id"], o["win_timestamp"], o["alert_timestamp"], F.lit(integration), o["alert_id"],
        o["agent_name_printed"],
    )

    def spelled(quoted: Column) -> Column:
        detail = jt.object_text(
            event_format=quoted[0], event_id=quoted[1], win_timestamp=quoted[2], wz_timestamp=quoted[3]
        )
        return jt.object_text(
            integration=quoted[4], alert_id=quoted[5], agent_name=quoted[6], **{fixed.ACK_DETAIL_FIELD: detail}
        )

    return let(F.transform(texts, jt.quoted), spelled)


def acknowledgements(
    messages: DataFrame, integration: str = fixed.ACK_INTEGRATION, keep: list[str] | None = None
) -> DataFrame:
    """One acknowledgement row per delivered message: fields, framed line, size flag.

    An alert whose agent is no object is delivered but not acknowledged.
    """
    o = F.col("origin")
    known = messages.where(
        F.col("origin.agent_kind").isNull() | F.startswith("origin.agent_kind", F.lit("OBJECT"))
    )
    body = ack_body(o, F.col("message.event_format"), integration)
    rows = known.select(
        *(keep or []),
        F.lit(integration).alias("integration"),
        o["alert_id"].alias("alert_id"),
        o["agent_name_printed"].alias("agent_name"),
        F.col("message.event_format").alias("event_format"),
        o["event_id"].alias("alert_event_id"),
        o["win_timestamp"].alias("win_timestamp"),
        o["alert_timestamp"].alias("alert_timestamp"),
        ack_line(body, o["agent_id"], o["agent_name"], o["agent_ip"], integration).alias("line"),
    )
    return rows.withColumn("oversize", oversize_line(F.col("line")))


def oversize_line(line: Column, limit: int = fixed.MAX_ACK_CHARS) -> Column:
    """The framed line is longer than the receiver accepts; it is still sent."""
    return F.length(line) > limit


def error_line(description: Column, integration: str = fixed.ACK_INTEGRATION) -> Column:
    body = jt.object_text(
        error=F.lit(str(fixed.ERROR_CODE)),
        description=jt.quoted(description),
        integration=jt.quoted(F.lit(integration)),
    )
    return _framed(body, integration)


def error_rows(
    rows: DataFrame, description: Column, keep: list[str] | None = None, integration: str = fixed.ACK_INTEGRATION
) -> DataFrame:
    """Error rows for every input row that has a description."""
    described = rows.select(*(keep or []), description.alias("description")).where(F.col("description").isNotNull())
    return described.select(
        *(keep or []),
        F.lit(fixed.ERROR_CODE).alias("error"),
        "description",
        F.lit(integration).alias("integration"),
        error_line(F.col("description"), integration).alias("line"),
    )


def incident_rows(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Error rows for messages that went out incomplete."""
    return error_rows(messages, F.col("incident"), keep)
