"""Messages, acknowledgements and rejections of single alerts."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from alertloom.fixed_values import EVENT_PARSER
from alertloom.operators import delivery, dispatch, ingest
from alertloom.plans import alert_plan
from tests.fixtures import fail2ban, windows


@pytest.fixture(scope="module")
def run(spark):
    def outcome(alerts, own_network=None):
        lines = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(alerts)], "n int, line string")
        parsed = ingest.accepted(ingest.parse_lines(lines, "{"))
        rows = dispatch.outcomes(parsed, own_network, ["n"]).cache()
        values = {
            (r.n, r.branch): json.loads(r.value)
            for r in dispatch.messages(rows).select("n", "branch", delivery.encode(rows["message"]).alias("value")).collect()
        }
        reasons = {(r.n, r.branch): r.drop_reason for r in dispatch.rejected(rows).collect()}
        acks = {r.n: r.line for r in delivery.acknowledgements(dispatch.messages(rows), keep=["n"]).collect()}
        errors = {r.n: r.line for r in delivery.incident_rows(dispatch.messages(rows), ["n"]).collect()}
        return values, reasons, acks, errors

    return outcome


def test_fail2ban_messages(run):
    alerts = [
        fail2ban(1, "INFO", "fail2ban.filter"), fail2ban(2), fail2ban(3, "WARNING"), fail2ban(4, "ERROR", action="Unban"),
        fail2ban(5, None),
    ]
    del alerts[4]["agent"], alerts[4]["data"]["pid"]
    values, reasons, acks, _ = run(alerts)
    assert sorted(n for n, _ in values) == [1, 2, 3, 4] and not reasons
    assert values[1, "fail2ban"] == {
        "timestamp": "2031-05-17T08:42:13.250+0000", "event_format": "syslog5424-json", "event_forward": True,
        "event_parser": EVENT_PARSER, "event_source": "soc-agent", "hostName": "edge-mail", "structuredData": "",
        "event_raw": "<37> 1 2031-05-17 08:42:13,250 fail2ban.actions [40417]: NOTICE [sshd] Ban 198.51.100.2",
        "body": "NOTICE [sshd] Ban 198.51.100.2", "appName": "fail2ban.actions", "appInst": "fail2ban.actions",
        "procId": "40417", "facility": "4", "priority": 37, "severity": 5,
    }
    assert [values[n, "fail2ban"]["priority"] for n in (2, 3, 4)] == [36, 35, 38]
    without = values[4, "fail2ban"]
    assert without["hostName"] == "" and "procId" not in without and without["body"] == without["event_raw"]
    detail = '"dfn": {"event_format": "syslog5424-json", "event_id": null, "win_timestamp": null, "wz_timestamp": "2031-05-17T08:42:13.250+0000"}}'
    assert acks[1] == '1:[731] (edge-mail) 10.44.7.19->dfn:{"integration": "dfn", "alert_id": "55.2", "agent_name": "edge-mail", ' + detail
    assert acks[4] == '1:dfn:{"integration": "dfn", "alert_id": "55.5", "agent_name": "None", ' + detail


def test_fail2ban_edges(run):
    base = fail2ban(2)
    text_group = fail2ban(2) | {"rule": {"groups": "syslog fail2ban x"}}
    other_group = fail2ban(2) | {"rule": {"groups": ["sshd"]}}
    no_source, null_log, no_log, number_log = fail2ban(2), fail2ban(2), fail2ban(2), fail2ban(2)
    no_source["data"]["srcip"] = ""
    null_log["full_log"] = None
    del no_log["full_log"]
    number_log["full_log"] = 7
    glued = fail2ban(2) | {"full_log": "fail2ban.actions: NOTICE x"}
    odd_severity = fail2ban(2)
    odd_severity["data"]["severity"] = 5
    values, reasons, *_ = run([base, text_group, other_group, no_source, null_log, no_log, number_log, glued, odd_severity])
    assert sorted(n for n, _ in values) == [0, 1, 4, 7]
    assert values[4, "fail2ban"]["event_raw"] == "<37> 1 None"
    assert values[7, "fail2ban"]["event_raw"] == "<37> 1 ctions: NOTICE x"
    assert {n: r for (n, _), r in reasons.items()} == {
        3: "no_source", 5: "missing_field", 6: "non_string_field", 8: "non_string_field",
    }


def test_own_network(run):
    alerts = []
    for address in ("8.8.8.8", "10.1.2.3", "203.0.113.9", "9.9.9.9", "2001:4860::1", "bad"):
        alert = fail2ban(2)
        alert["data"]["srcip"] = address
        alerts.append(alert)
    assert sorted(n for n, _ in run(alerts)[0]) == [0, 1, 2, 3, 4, 5]
    values, reasons, *_ = run(alerts, "9.9.0.0/16")
    assert sorted(n for n, _ in values) == [0, 4] and set(reasons.values()) == {"internal_source"}


def _expected_event(alert):
    """The event XML by ElementTree."""
    event = ET.Element("Event", {"xmlns": "http://schemas.microsoft.com/win/2004/08/events/event"})
    s = alert["data"]["win"]["system"]
    system = ET.SubElement(event, "System")
    ET.SubElement(system, "Provider", {"Name": s["providerName"], "Guid": s["providerGuid"]})
    for tag, key in (("EventID", "eventID"), ("Version", "version"), ("Level", "level"), ("Task", "task"),
                     ("Opcode", "opcode"), ("Keywords", "keywords")):
        ET.SubElement(system, tag).text = s.get(key, "")
    ET.SubElement(system, "TimeCreated", {"SystemTime": s["systemTime"]} if "systemTime" in s else {})
    ET.SubElement(system, "EventRecordID").text = s.get("eventRecordID", "")
    ET.SubElement(system, "Correlation")
    ET.SubElement(system, "Execution", {"ProcessID": s.get("processID", ""), "ThreadID": s.get("threadID", "")})
    ET.SubElement(system, "Channel").text = s.get("channel", "")
    ET.SubElement(system, "Computer").text = s.get("computer", "")
    ET.SubElement(system, "Security")
    return event


def _titled(key):
    return key[:1].upper() + key[1:]


def test_windows_event_data(run):
    eventdata = {
        "zeta": "1", "alpha": 'a & b < c > "d"', "ßx": "é\n", "empty": "", "none": None, "ipAddress": "", "quote\"&<": "v",
    }
    alert = windows("4625", eventdata=eventdata)
    alert["data"]["win"]["system"] |= {"providerName": 'x"&<>\r\n\ty', "level": "<&>", "task": None}
    for key in ("opcode", "systemTime", "threadID"):
        del alert["data"]["win"]["system"][key]
    event = _expected_event(alert)
    data = ET.SubElement(event, "EventData")
    for key, value in eventdata.items():
        ET.SubElement(data, "Data", {"Name": key[0].upper() + key[1:]}).text = value
    ET.SubElement(data, "Data", {"Name": "IpPort"}).text = "-"
    values, *_ = run([alert])
    message = values[0, "windows"]
    assert message["event_raw"] == message["body"] == ET.tostring(event, encoding="unicode")
    assert message["data"] == alert["data"] and list(message["data"]["win"]["eventdata"]) == list(eventdata)


def test_windows_user_data(run):
    cleared = {"subjectUserName": "Admin", "clientProcessId": "2281", "none": None}
    alerts = [
        windows("1102", logFileCleared=cleared), windows("1102"), windows("1102", logFileCleared={}),
        windows("1100", eventdata={"a": "b"}), windows("4719", eventdata={}), windows("4719"), windows("4624", eventdata={}),
    ]
    values, reasons, acks, errors = run(alerts)
    raw = {n: v["event_raw"] for (n, _), v in values.items()}
    space = 'xmlns="http://manifests.microsoft.com/win/2004/08/windows/eventlog"'
    assert raw[0].endswith(
        f"</System><UserData><LogFileCleared {space}><SubjectUserName>Admin</SubjectUserName>"
        "<ClientProcessId>2281</ClientProcessId><None /></LogFileCleared></UserData></Event>"
    )
    assert raw[1].endswith("</System></Event>")
    assert raw[2].endswith(f"</System><UserData><LogFileCleared {space} /></UserData></Event>")
    assert raw[3].endswith(f"</System><UserData><ServiceShutdown {space} /></UserData></Event>")
    assert raw[4].endswith("</System><EventData /></Event>")
    assert raw[5].endswith("</System></Event>") and 6 not in raw and not reasons
    text = "Incomplete Windows alert. No eventdata found. alert_id: 55.601, agent_id: 418, agent_name: desk-west"
    assert errors == {5: f'1:dfn:{{"error": 503, "description": "{text}", "integration": "dfn"}}'}
    assert '"event_id": "1102", "win_timestamp": "2031-05-17T08:42:13.250Z"' in acks[0]


def test_windows_rejections(run):
    cases = []
    for change in (
        lambda a: a["data"]["win"]["system"].pop("providerName"),
        lambda a: a.pop("timestamp"),
        lambda a: a["data"]["win"]["system"].update(eventID=4625),
        lambda a: a["data"]["win"]["system"].update(processID=None),
        lambda a: a["data"]["win"].update(eventdata={"a": 5}),
        lambda a: a["data"]["win"].update(eventdata={"": "x"}),
        lambda a: a["data"]["win"].update(eventdata="text"),
        lambda a: (a["data"]["win"].pop("eventdata"), a.pop("agent")),
    ):
        alert = windows("4625", eventdata={"a": "b"})
        change(alert)
        cases.append(alert)
    values, reasons, *_ = run(cases)
    assert not values
    assert [reasons[n, "windows"] for n in range(8)] == [
        "missing_field", "missing_field", "non_string_field", "non_string_field", "bad_event_data", "bad_event_data",
        "bad_event_data", "missing_field",
    ]


def test_both_branches_take_one_alert(run):
    alert = windows("4625", eventdata={"a": "b"}) | {"full_log": "x"}
    alert["data"] |= fail2ban(2)["data"]
    alert["rule"] = {"groups": ["fail2ban"]}
    values, *_ = run([alert])
    assert sorted(branch for _, branch in values) == ["fail2ban", "windows"]


def test_repeated_keys_last_wins(spark):
    line = '{"timestamp":"t","data":{"win":1},"data":' + json.dumps(windows("4625", eventdata={})["data"])[:-2]
    line = line.replace('"eventdata": {}', '"eventdata": {"b": "1", "a": "2", "b": "3"}') + "}},\"id\":1}"
    assert list(json.loads(line)["data"]["win"]["eventdata"].items()) == [("b", "3"), ("a", "2")]
    parsed = ingest.accepted(ingest.parse_lines(spark.createDataFrame([(line,)], "line string")))
    raw = dispatch.messages(dispatch.outcomes(parsed)).select("message.event_raw").head()[0]
    assert '<EventData><Data Name="B">3</Data><Data Name="A">2</Data>' in raw


def test_ack_location_escapes(run):
    alert = fail2ban(2)
    alert["agent"] = {"id": "0|2", "name": "a:b"}
    assert run([alert])[2][0].startswith("1:[0||2] (a|:b) any->dfn:{")


def test_kafka_options():
    options = delivery.kafka_options("b:9092", "customer", overrides={"acks": "all", "linger.ms": 9}, keystore="/k")
    assert options["kafka.acks"] == "all" and options["kafka.linger.ms"] == "5" and options["topic"] == "customer"
    assert options["kafka.security.protocol"] == "SSL" and options["kafka.compression.type"] == "gzip"


# Further handlers


def _audit_fields(alert):
    user = F.try_variant_get(alert, "$.data.user", "string")
    return F.struct(
        F.lit("audit").alias("event_format"), F.concat(F.lit("login "), user).alias("raw"), user.alias("body"), F.lit(7).alias("severity"),
        F.when(user == "root", "not sent").alias("drop_reason"),
    )


def _fragile(text):
    alert = json.loads(text)
    return {"event_format": "fragile", "raw": alert["data"]["user"], "priority": 100 // alert["data"]["n"]} if "n" in alert["data"] else None


def test_further_handlers_share_the_pass(spark, tmp_path):
    kind = lambda alert, name: F.coalesce(F.try_variant_get(alert, "$.kind", "string") == name, F.lit(False))
    handlers = (
        dispatch.Handler("audit", lambda a: kind(a, "login") | kind(a, "both"), _audit_fields),
        dispatch.Handler("fragile", lambda a: kind(a, "odd") | kind(a, "both"), dispatch.by_python(_fragile)),
    )
    alerts = [
        fail2ban(2), {"id": "1", "kind": "login", "data": {"user": "ann"}}, {"id": "2", "kind": "login", "data": {"user": "root"}},
        {"id": "3", "kind": "odd", "data": {"user": "x", "n": 0}}, {"id": "4", "kind": "odd", "data": {"user": "y", "n": 5}},
        {"id": "5", "kind": "odd", "data": {}}, {"id": "6", "kind": "odd"}, {"id": "7", "kind": "both", "data": {"user": "z", "n": 4}}, {"id": "8"},
    ]
    (tmp_path / "lines").write_text("\n".join(map(json.dumps, alerts)))
    lines = spark.read.text(str(tmp_path / "lines")).withColumnRenamed("value", "line")
    rows = dispatch.outcomes(ingest.accepted(ingest.parse_lines(lines, "{")), handlers=handlers)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r.origin.alert_id, r.branch): r for r in rows.collect()}
    assert len(found) == 9
    sent = {k: (r.message.event_format, r.message.event_raw, r.message.severity, r.message.priority) for k, r in found.items() if r.drop_reason is None}
    assert sent.pop(("55.2" if ("55.2", "fail2ban") in sent else next(i for i, b in sent if b == "fail2ban"), "fail2ban"))[0] == "syslog5424-json"
    assert sent == {
        ("1", "audit"): ("audit", "login ann", 7, None), ("7", "audit"): ("audit", "login z", 7, None),
        ("4", "fragile"): ("fragile", "y", None, 20), ("7", "fragile"): ("fragile", "z", None, 25),
    }
    reasons = {k: r.drop_reason for k, r in found.items() if r.drop_reason is not None}
    assert reasons.pop(("3", "fragile")).startswith("ZeroDivisionError") and reasons.pop(("6", "fragile")).startswith("KeyError")
    assert reasons == {("2", "audit"): "not sent", ("5", "fragile"): "not handled"}
    streams = alert_plan.records(lines, alert_plan.AlertJob("t", prefix="{", handlers=handlers))
    assert streams.where("stream = 'message'").count() == 5 and streams.where("stream = 'rejected'").count() == 4


def test_handlers_need_names_of_their_own(spark):
    twice = dispatch.Handler("windows", lambda a: F.lit(True), _audit_fields)
    with pytest.raises(ValueError, match="names of their own"):
        dispatch.branches(spark.createDataFrame([], "line string"), (twice,))
