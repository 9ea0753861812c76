"""Windows event log alerts: relevance, event XML, message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text as jt
from alertloom.functions import xmltext
from alertloom.functions.bind import let

SYSTEM = "$.data.win.system"

# Element text may be absent or null; attribute values must be strings.
TEXT_FIELDS = (
    "eventID", "version", "level", "task", "opcode", "keywords", "eventRecordID", "channel", "computer",
)
ATTRIBUTE_FIELDS = ("providerName", "providerGuid", "systemTime", "processID", "threadID")

DATA_SCHEMA = (
    "win STRUCT<eventdata: MAP<STRING, STRING>, logFileCleared: MAP<STRING, STRING>>"
)


def is_relevant(alert: Column) -> Column:
    """The alert carries one of the monitored event ids, as text or as a number."""
    event_id = jt.text_at(alert, f"{SYSTEM}.eventID")
    return F.coalesce(event_id.isin(*fixed.MONITORED_EVENT_IDS), F.lit(False))


def data_text(text: Column) -> Column:
    """The ``data`` object of the alert line as JSON text, key order kept."""
    return F.from_json(text, "data STRING")["data"]


def fields(alert: Column) -> Column:
    """What the XML needs, with the type of each value next to its text."""
    names = (*TEXT_FIELDS, *ATTRIBUTE_FIELDS)
    values = [jt.text_at(alert, f"{SYSTEM}.{n}").alias(n) for n in names]
    kinds = [jt.type_name(alert, f"{SYSTEM}.{n}").alias(f"{n}_kind") for n in names]
    return F.struct(
        *values,
        *kinds,
        jt.present(alert, "$.timestamp").alias("has_timestamp"),
        (jt.present(alert, "$.id") & jt.present(alert, "$.agent.id") & jt.present(alert, "$.agent.name")).alias(
            "has_identity"
        ),
        jt.type_name(alert, "$.data.win.eventdata").alias("eventdata_kind"),
        jt.type_name(alert, "$.data.win.logFileCleared").alias("cleared_kind"),
        jt.only_text_values(alert, "$.data.win.eventdata").alias("eventdata_text_only"),
        jt.only_text_values(alert, "$.data.win.logFileCleared").alias("cleared_text_only"),
    )


def system_xml(f: Column) -> Column:
    """The ``System`` element; absent optional fields become empty elements."""
    texts = F.transform(F.array(*[f[n] for n in TEXT_FIELDS]), xmltext.escape_text)
    values = F.transform(F.array(*[f[n] for n in ATTRIBUTE_FIELDS]), xmltext.escape_attribute)
    return let(F.struct(texts.alias("text"), values.alias("value")), _system_of_escaped)


def _system_of_escaped(escaped: Column) -> Column:
    text = lambda tag, name: xmltext.filled(tag, escaped["text"][TEXT_FIELDS.index(name)])
    value = lambda name: F.coalesce(escaped["value"][ATTRIBUTE_FIELDS.index(name)], F.lit(""))
    system_time = escaped["value"][ATTRIBUTE_FIELDS.index("systemTime")]
    name, guid = (escaped["value"][ATTRIBUTE_FIELDS.index(n)] for n in ("providerName", "providerGuid"))
    return F.concat(
        F.lit('<System><Provider Name="'), name, F.lit('" Guid="'), guid, F.lit('" />'),
        text("EventID", "eventID"),
        text("Version", "version"),
        text("Level", "level"),
        text("Task", "task"),
        text("Opcode", "opcode"),
        text("Keywords", "keywords"),
        F.coalesce(F.concat(F.lit('<TimeCreated SystemTime="'), system_time, F.lit('" />')), F.lit("<TimeCreated />")),
        text("EventRecordID", "eventRecordID"),
        F.lit('<Correlation /><Execution ProcessID="'), value("processID"),
        F.lit('" ThreadID="'), value("threadID"), F.lit('" />'),
        text("Channel", "channel"),
        text("Computer", "computer"),
        F.lit("<Security /></System>"),
    )


def event_data_items(parsed: Column, event_id: Column) -> Column:
    """``Data`` elements, one per entry in input order, address defaults last."""
    named = lambda name: F.concat(
        F.lit(' Name="'), xmltext.escape_attribute(xmltext.first_upper(name)), F.lit('"')
    )
    items = F.array_join(
        F.transform(jt.ordered_entries(parsed), lambda e: xmltext.element("Data", e["value"], named(e["key"]))), ""
    )
    wants_address = event_id.isin(*fixed.EVENT_IDS_WITH_ADDRESS_DEFAULTS)
    keys = F.map_keys(parsed)
    default = lambda key, name: F.when(
        wants_address & ~F.array_contains(keys, key), F.lit(f'<Data Name="{name}">-</Data>')
    ).otherwise("")
    return F.concat(items, default("ipAddress", "IpAddress"), default("ipPort", "IpPort"))


def shutdown_xml() -> Column:
    """``UserData`` of event 1100, the same for every alert."""
    return F.lit(f'<UserData><ServiceShutdown xmlns="{fixed.EVENTLOG_NAMESPACE}" /></UserData>')


def log_cleared_items(parsed: Column) -> Column:
    """Child elements of ``LogFileCleared``, one per entry."""
    return F.array_join(
        F.transform(
            jt.ordered_entries(parsed), lambda e: xmltext.element(xmltext.first_upper(e["key"]), e["value"])
        ),
        "",
    )


def data_items(f: Column, eventdata: Column, cleared: Column) -> Column:
    """The serialised children of the data part; NULL where there is none to fill."""
    event_id = f["eventID"]
    return F.when(event_id == "1102", log_cleared_items(cleared)).when(
        event_id != "1100", event_data_items(eventdata, event_id)
    )


def data_xml(f: Column, items: Column) -> Column:
    """The data part an event id calls for: ``EventData``, ``UserData`` or nothing."""
    event_id = f["eventID"]
    cleared = xmltext.container("LogFileCleared", items, f' xmlns="{fixed.EVENTLOG_NAMESPACE}"')
    return (
        F.when(event_id == "1100", shutdown_xml())
        .when(
            event_id == "1102",
            F.when(f["cleared_kind"].isNotNull(), xmltext.wrap("UserData", cleared)).otherwise(""),
        )
        .when(f["eventdata_kind"].isNotNull(), xmltext.container("EventData", items))
        .otherwise("")
    )


def event_xml(f: Column, items: Column) -> Column:
    """The whole event; ``items`` comes from ``data_items`` in an earlier projection."""
    return xmltext.wrap(
        "Event", F.concat(system_xml(f), data_xml(f, items)), f' xmlns="{fixed.EVENT_NAMESPACE}"'
    )


def drop_reason(f: Column, eventdata: Column, cleared: Column) -> Column:
    """Why a relevant alert yields no message; NULL if it does."""
    event_id = f["eventID"]
    required = (
        ~f["has_timestamp"] | f["providerName_kind"].isNull() | f["providerGuid_kind"].isNull()
    )
    bad_text = F.lit(False)
    for name in TEXT_FIELDS:
        bad_text = bad_text | F.coalesce(~f[f"{name}_kind"].isin("STRING", "VOID"), F.lit(False))
    for name in ATTRIBUTE_FIELDS:
        bad_text = bad_text | F.coalesce(f[f"{name}_kind"] != "STRING", F.lit(False))

    def bad_object(kind: Column, text_only: Column, parsed: Column) -> Column:
        is_object = F.startswith(kind, F.lit("OBJECT"))
        fine = is_object & text_only & ~F.array_contains(F.map_keys(parsed), "")
        return kind.isNotNull() & ~F.coalesce(fine, F.lit(False))

    uses_eventdata = ~event_id.isin("1100", "1102")
    return (
        F.when(required, "missing_field")
        .when(uses_eventdata & f["eventdata_kind"].isNull() & ~f["has_identity"], "missing_field")
        .when(bad_text, "non_string_field")
        .when(uses_eventdata & bad_object(f["eventdata_kind"], f["eventdata_text_only"], eventdata), "bad_event_data")
        .when((event_id == "1102") & bad_object(f["cleared_kind"], f["cleared_text_only"], cleared), "bad_event_data")
    )


def incomplete(f: Column) -> Column:
    """The message goes out without a data part and an error row accompanies it."""
    return ~f["eventID"].isin("1100", "1102") & f["eventdata_kind"].isNull()
