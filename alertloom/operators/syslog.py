"""fail2ban alerts: relevance, source filter, syslog-style message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text as jt
from alertloom.functions import net


def is_relevant(alert: Column) -> Column:
    """A ban action: source key, exact program name and the group of the rule."""
    groups = "$.rule.groups"
    kind = jt.type_name(alert, groups)
    text = jt.text_at(alert, groups)
    in_groups = (
        F.when(
            F.startswith(kind, F.lit("ARRAY")),
            F.array_contains(F.try_variant_get(alert, groups, "array<string>"), fixed.FAIL2BAN_GROUP),
        )
        .when(kind == "STRING", F.contains(text, F.lit(fixed.FAIL2BAN_GROUP)))
        .when(F.startswith(kind, F.lit("OBJECT")), jt.present(alert, f"{groups}.{fixed.FAIL2BAN_GROUP}"))
    )
    program = jt.text_at(alert, "$.data.program_name")
    return F.coalesce(
        F.when((program == fixed.FAIL2BAN_PROGRAM) & jt.present(alert, "$.data.srcip"), in_groups), F.lit(False)
    )


def fields(alert: Column) -> Column:
    """What the message needs, with value types where they decide the outcome."""
    return F.struct(
        jt.text_at(alert, "$.data.srcip").alias("srcip"),
        jt.type_name(alert, "$.data.srcip").alias("srcip_kind"),
        jt.text_at(alert, "$.data.severity").alias("severity"),
        jt.type_name(alert, "$.data.severity").alias("severity_kind"),
        jt.text_at(alert, "$.data.program_name").alias("program"),
        jt.text_at(alert, "$.data.pid").alias("pid"),
        jt.type_name(alert, "$.agent").alias("agent_kind"),
        jt.present(alert, "$.agent.name").alias("has_agent_name"),
        jt.text_at(alert, "$.agent.name").alias("agent_name"),
        jt.text_at(alert, "$.full_log").alias("full_log"),
        jt.type_name(alert, "$.full_log").alias("full_log_kind"),
        jt.present(alert, "$.timestamp").alias("has_timestamp"),
    )


def empty_source(f: Column) -> Column:
    """The source is null, an empty string, zero, false or an empty container."""
    return F.coalesce(
        (f["srcip_kind"] == "VOID") | f["srcip"].isin("", "0", "0.0", "false", "[]", "{}"), F.lit(True)
    ) & ~((f["srcip_kind"] == "STRING") & (f["srcip"] != ""))


def source_is_sent(f: Column, own_network: str | None) -> Column:
    """Without an own network every source is sent, with one only global sources."""
    if not own_network:
        return F.lit(True)
    return (f["srcip_kind"] == "STRING") & net.is_global(f["srcip"], own_network)


def severity(f: Column) -> Column:
    """Severity number; the word must match exactly."""
    number = F.lit(fixed.SYSLOG_DEFAULT_SEVERITY)
    for word, value in fixed.SYSLOG_SEVERITY.items():
        number = F.when((f["severity_kind"] == "STRING") & (f["severity"] == word), value).otherwise(number)
    return number.cast("int")


def priority(severity_number: Column) -> Column:
    return (severity_number + fixed.SYSLOG_FACILITY * 8).cast("int")


def log_text(f: Column) -> Column:
    """``full_log`` without the ten characters that lead a fail2ban line."""
    line = f["full_log"]
    cut = F.when(F.startswith(line, F.lit("fail2ban")), F.substring(line, 11, 2147483647)).otherwise(line)
    return F.coalesce(cut, F.lit("None"))


def event_raw(f: Column) -> Column:
    return F.concat(F.lit("<"), priority(severity(f)).cast("string"), F.lit("> 1 "), log_text(f))


def body(raw: Column, f: Column) -> Column:
    """From the first severity word in the raw event on; all of it if there is none."""
    at = F.instr(raw, f["severity"])
    return F.when((F.length(f["severity"]) > 0) & (at > 0), F.substr(raw, at, F.lit(2147483647))).otherwise(raw)


def drop_reason(f: Column, own_network: str | None = None) -> Column:
    """Why a relevant alert yields no message; NULL if it does."""
    bad_severity = ~f["severity_kind"].isin("STRING", "VOID")
    return (
        F.when(empty_source(f), "no_source")
        .when(~source_is_sent(f, own_network), "internal_source")
        .when(~f["has_timestamp"] | f["full_log_kind"].isNull(), "missing_field")
        .when(f["agent_kind"].isNotNull() & ~F.startswith(f["agent_kind"], F.lit("OBJECT")), "bad_agent")
        .when(~f["full_log_kind"].isin("STRING", "VOID") | F.coalesce(bad_severity, F.lit(False)), "non_string_field")
    )
