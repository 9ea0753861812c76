"""Give every alert to both branches and build the outgoing messages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text as jt
from alertloom.operators import syslog, windows

WINDOWS = "windows"
FAIL2BAN = "fail2ban"
QUARANTINE = "quarantine"
REPAIRED = "replaced"


# What a handler may say of a message, with its type; what it leaves out is NULL.
MESSAGE_FIELDS = {
    "event_format": "string", "raw": "string", "body": "string", "data": "string", "host": "string", "structured": "string",
    "app": "string", "process": "string", "facility": "string", "priority": "int", "severity": "int",
}


@dataclass(frozen=True)
class Handler:
    """A further kind of alert: which alerts it wants, and what it makes of them.

    ``wanted`` and ``fields`` get the alert (VARIANT).  ``fields`` gives a struct with any of
    ``MESSAGE_FIELDS`` and maybe ``drop_reason``, the text why there is no message.  All
    handlers are planned into the one pass over the alerts.  ``by_python`` makes ``fields``
    of a Python function.
    """

    name: str
    wanted: Callable[[Column], Column]
    fields: Callable[[Column], Column]


def by_python(function: Callable[[str], dict | None]) -> Callable[[Column], Column]:
    """Fields from a Python function of the alert's JSON text, in Arrow batches.

    An alert that the function gives None for, or fails on, has a ``drop_reason``; other
    alerts and other handlers do not notice.
    """
    names = [*MESSAGE_FIELDS, "drop_reason"]

    def row(text: str | None) -> dict:
        try:
            # Other branches' alerts come without a text.
            found = function(text) if text is not None else {}
            if found is None:
                return {"drop_reason": "not handled"}
            return {k: None if found.get(k) is None else int(found[k]) if MESSAGE_FIELDS.get(k) == "int" else str(found[k]) for k in names}
        except Exception as error:  # noqa: BLE001  whatever a user's function raises concerns its own alert only
            return {"drop_reason": f"{type(error).__name__}: {error}"}

    kinds = pa.struct([(k, pa.int32() if MESSAGE_FIELDS.get(k) == "int" else pa.string()) for k in names])

    @F.arrow_udf(", ".join(f"{k} {MESSAGE_FIELDS.get(k, 'string')}" for k in names))
    def fields(texts: pa.Array) -> pa.Array:
        return pa.array([row(t) for t in texts.to_pylist()], kinds)

    return lambda alert: fields(F.to_json(alert))


def _checked(handlers: Sequence[Handler]) -> None:
    names = [WINDOWS, FAIL2BAN, QUARANTINE, *[h.name for h in handlers]]
    if len(set(names)) < len(names):
        raise ValueError(f"handlers need names of their own: {names}")


def with_relevance(alerts: DataFrame) -> DataFrame:
    """Booleans ``is_windows``, ``is_fail2ban`` and ``is_relevant``; no row is dropped."""
    marked = alerts.select(
        "*",
        jt.once(
            is_windows=windows.is_relevant(F.col("alert")), is_fail2ban=syslog.is_relevant(F.col("alert"))
        ),
    )
    return marked.withColumn("is_relevant", F.col("is_windows") | F.col("is_fail2ban"))


def branches(rows: DataFrame, handlers: Sequence[Handler] = ()) -> DataFrame:
    """One row per input row and branch that wants it: column ``branch``.

    An alert that both branches want gives two rows; the input is read once.
    Rows of ``strict_parse`` that failed, or were repaired, also go to the
    quarantine branch.
    """
    _checked(handlers)
    alert = F.col("alert")
    wanted = [
        F.when(windows.is_relevant(alert), F.lit(WINDOWS)),
        F.when(syslog.is_relevant(alert), F.lit(FAIL2BAN)),
        *[F.when(h.wanted(alert), F.lit(h.name)) for h in handlers],
    ]
    if "reason" in rows.columns:
        wanted.append(F.when(F.col("reason").isNotNull() | F.col("replaced"), F.lit(QUARANTINE)))
    return rows.select("*", F.explode(F.array(*wanted)).alias("branch")).where(F.col("branch").isNotNull())


def _origin(alert: Column) -> Column:
    """Identity of the alert for acknowledgement and error rows."""
    return F.struct(
        jt.printed(alert, "$.id").alias("alert_id"),
        jt.text_at(alert, "$.agent.id").alias("agent_id"),
        jt.text_at(alert, "$.agent.name").alias("agent_name"),
        jt.printed(alert, "$.agent.id").alias("agent_id_printed"),
        jt.printed(alert, "$.agent.name").alias("agent_name_printed"),
        F.when(jt.present(alert, "$.agent.ip"), jt.printed(alert, "$.agent.ip")).otherwise("any").alias("agent_ip"),
        jt.type_name(alert, "$.agent").alias("agent_kind"),
        F.when(F.col("branch") == WINDOWS, jt.text_at(alert, f"{windows.SYSTEM}.eventID")).alias("event_id"),
        F.when(F.col("branch") == WINDOWS, jt.text_at(alert, f"{windows.SYSTEM}.systemTime")).alias("win_timestamp"),
        jt.text_at(alert, "$.timestamp").alias("alert_timestamp"),
    )


def _windows_message(xml: Column) -> Column:
    none = F.lit(None).cast("string")
    return _message(
        F.lit(fixed.EVENT_FORMAT_WINDOWS), xml, xml, data=F.col("data"), host=none, structured=none, app=none,
        process=none, facility=none, priority=F.lit(None).cast("int"), severity=F.lit(None).cast("int"),
    )


def _syslog_message(f: Column, raw: Column) -> Column:
    number = syslog.severity(f)
    host = F.when(f["has_agent_name"], f["agent_name"]).otherwise("")
    return _message(
        F.lit(fixed.EVENT_FORMAT_SYSLOG), raw, syslog.body(raw, f), data=F.lit(None).cast("string"), host=host,
        structured=F.lit(""), app=f["program"], process=f["pid"], facility=F.lit(str(fixed.SYSLOG_FACILITY)),
        priority=syslog.priority(number), severity=number,
    )


def _message(
    event_format: Column, raw: Column, body: Column, *, data: Column, host: Column, structured: Column,
    app: Column, process: Column, facility: Column, priority: Column, severity: Column,
) -> Column:
    return F.struct(
        F.col("origin.alert_timestamp").alias("timestamp"),
        event_format.alias("event_format"),
        F.lit(True).alias("event_forward"),
        F.lit(fixed.EVENT_PARSER).alias("event_parser"),
        F.lit(fixed.EVENT_SOURCE).alias("event_source"),
        raw.alias("event_raw"),
        body.alias("body"),
        data.alias("data"),
        host.alias("hostName"),
        structured.alias("structuredData"),
        app.alias("appName"),
        app.alias("appInst"),
        process.alias("procId"),
        facility.alias("facility"),
        priority.alias("priority"),
        severity.alias("severity"),
    )


def _handled(fields: Column, kinds: list[str]) -> Column:
    named = {k: (fields[k] if k in kinds else F.lit(None)).cast(kind) for k, kind in MESSAGE_FIELDS.items()}
    return _message(named.pop("event_format"), named.pop("raw"), named.pop("body"), **named)


def outcomes(
    alerts: DataFrame, own_network: str | None = None, keep: list[str] | None = None, handlers: Sequence[Handler] = ()
) -> DataFrame:
    """One row per alert and branch: the message, or the reason why there is none.

    Input needs ``alert`` (VARIANT) and ``text``; with the ``reason`` of
    ``strict_parse`` its quarantined rows come out too, as branch ``quarantine``.
    Output: the ``keep`` columns,
    ``branch``, ``origin``, ``message``, ``drop_reason`` and ``incident`` (text of
    an error to report although the message is sent).  ``handlers`` add branches of
    their own to the same pass.
    """
    keep = keep or []
    alert, is_windows = F.col("alert"), F.col("branch") == WINDOWS
    is_syslog = F.col("branch") == FAIL2BAN
    failure = F.col("reason") if "reason" in alerts.columns else F.lit(None).cast("string")
    # A handler's fields are made for its own alerts only; a Python one is not called for others.
    own = [h.fields(F.when(F.col("branch") == h.name, alert)).alias(f"h{k}") for k, h in enumerate(handlers)]
    base = branches(alerts, handlers).select(
        *keep,
        "branch",
        failure.alias("failure"),
        _origin(alert).alias("origin"),
        F.when(is_windows, windows.fields(alert)).alias("w"),
        F.when(is_syslog, syslog.fields(alert)).alias("s"),
        F.when(is_windows, windows.data_text(F.col("text"))).alias("data"),
        *own,
    )
    is_own = [F.col("branch") == h.name for h in handlers]
    kinds = [base.schema[f"h{k}"].dataType.fieldNames() for k in range(len(handlers))]
    none = F.lit(None).cast("string")
    lifted = base.withColumn("ordered", F.from_json("data", windows.DATA_SCHEMA))
    w, s = F.col("w"), F.col("s")
    eventdata, cleared = F.col("ordered.win.eventdata"), F.col("ordered.win.logFileCleared")
    reason = F.when(is_windows, windows.drop_reason(w, eventdata, cleared)).when(is_syslog, syslog.drop_reason(s, own_network))
    for k, mine in enumerate(is_own):
        reason = reason.when(mine, F.col(f"h{k}.drop_reason") if "drop_reason" in kinds[k] else none)
    reason = reason.otherwise(F.coalesce("failure", F.lit(REPAIRED)))
    decided = lifted.select("*", jt.once(drop_reason=reason))
    sent = F.col("drop_reason").isNull()
    spelled = decided.withColumn("items", F.when(is_windows & sent, windows.data_items(w, eventdata, cleared)))
    raw = F.when(is_windows, windows.event_xml(w, F.col("items"))).otherwise(syslog.event_raw(s))
    spelled = spelled.withColumn("raw", F.when(sent, raw))
    message = F.when(is_windows, _windows_message(F.col("raw")))
    for k, mine in enumerate(is_own):
        message = message.when(mine, _handled(F.col(f"h{k}"), kinds[k]))
    message = message.otherwise(_syslog_message(s, F.col("raw")))
    incident = F.concat(
        F.lit("Incomplete Windows alert. No eventdata found. alert_id: "), F.col("origin.alert_id"),
        F.lit(", agent_id: "), F.col("origin.agent_id_printed"),
        F.lit(", agent_name: "), F.col("origin.agent_name_printed"),
    )
    return spelled.select(
        *keep,
        "branch",
        "origin",
        F.when(sent, message).alias("message"),
        "drop_reason",
        F.when(sent & is_windows & windows.incomplete(w), incident).alias("incident"),
    )


def messages(outcome_rows: DataFrame) -> DataFrame:
    """Only the rows that go out."""
    return outcome_rows.where(F.col("drop_reason").isNull()).drop("drop_reason")


def rejected(outcome_rows: DataFrame) -> DataFrame:
    """Only the rows that a branch wanted but could not or must not send."""
    return outcome_rows.where(F.col("drop_reason").isNotNull()).drop("message", "incident")


def relevance_counts(outcome_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Selected alerts and outgoing messages per branch."""
    return outcome_rows.groupBy(*(keys or []), "branch").agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("drop_reason").isNull()).alias("messages")
    )
