"""From alert lines to everything that leaves the job, in one pass over the input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.operators import delivery, dispatch, ingest

MESSAGE, ACK, ERROR, REJECTED, QUARANTINE = "message", "ack", "error", "rejected", "quarantine"


@dataclass(frozen=True)
class AlertJob:
    """Parameters of an alert job."""

    topic: str
    own_network: str | None = None
    prefix: str = fixed.ALERT_PREFIX
    integration: str = fixed.ACK_INTEGRATION
    handlers: tuple[dispatch.Handler, ...] = ()


def parse(lines: DataFrame, job: AlertJob) -> DataFrame:
    return ingest.parse_lines(lines, job.prefix)


def outcomes(lines: DataFrame, job: AlertJob, keep: list[str] | None = None) -> DataFrame:
    """Messages, rejections and quarantined lines with their origin."""
    return dispatch.outcomes(parse(lines, job), job.own_network, keep, job.handlers)


def _record(stream: str, value: Column, reason: Column | None = None, raw: Column | None = None) -> Column:
    return F.struct(
        F.lit(stream).alias("stream"),
        value.cast("string").alias("value"),
        (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
        (raw if raw is not None else F.lit(None)).cast("binary").alias("raw"),
    )


def records(lines: DataFrame, job: AlertJob, keep: list[str] | None = None) -> DataFrame:
    """Every outgoing record with its ``stream``: message, ack, error, rejected or quarantine.

    One scan and one parse feed all streams, so a job writes them in one pass
    and sinks read the stream they want from the written table.
    """
    keep = keep or []
    rows = dispatch.outcomes(parse(lines, job), job.own_network, [*keep, "line", "text"], job.handlers)
    o, sent = F.col("origin"), F.col("drop_reason").isNull()
    in_quarantine = F.col("branch") == dispatch.QUARANTINE
    acked = sent & (o["agent_kind"].isNull() | F.startswith(o["agent_kind"], F.lit("OBJECT")))
    body = delivery.ack_body(o, F.col("message.event_format"), job.integration)
    line = delivery.ack_line(body, o["agent_id"], o["agent_name"], o["agent_ip"], job.integration)
    repaired = F.when(F.col("drop_reason") == dispatch.REPAIRED, F.col("text"))
    streams = F.array(
        F.when(sent, _record(MESSAGE, delivery.encode(F.col("message")))),
        F.when(acked, _record(ACK, line)),
        F.when(F.col("incident").isNotNull(), _record(ERROR, delivery.error_line(F.col("incident"), job.integration))),
        F.when(~sent & ~in_quarantine, _record(REJECTED, o["alert_id"], F.col("drop_reason"))),
        F.when(in_quarantine, _record(QUARANTINE, repaired, F.col("drop_reason"), F.col("line"))),
    )
    return (
        rows.select(*keep, "branch", F.explode(streams).alias("r"))
        .where(F.col("r").isNotNull())
        .select(*keep, "branch", "r.*")
    )
