"""Expected results of the alert queries, straight from the table columns."""

from __future__ import annotations

from alertloom.fixed_values import EVENT_PARSER, EVENT_SOURCE, MONITORED_EVENT_IDS

_IDS = ", ".join(f"'{i}'" for i in MONITORED_EVENT_IDS)
_SOURCES = (
    "['8.8.8.' || n, '10.0.0.' || n, '192.0.2.' || n, '100.64.1.' || n, '224.0.0.' || n, "
    "'2001:4860::' || n, 'fe80::' || n, 'bad', '']"
)

# e: event id, m: way of being broken, good: becomes an alert, f: framed.
BASE = f"""
WITH base0 AS (
  SELECT event_id AS e, user_id AS u, ts, event_type AS et, value AS v, event_id % 97 AS m,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, event_id % 200 AS n,
         CASE WHEN event_type = 'error' THEN list_extract([{_IDS}], event_id % 13 + 1) ELSE '4624' END AS wid
  FROM events),
base AS (
  SELECT *, m <> 6 AS f, m NOT IN (0, 2, 3, 6) AS good,
         CASE WHEN m = 4 THEN 'again-' || e ELSE e::VARCHAR END AS aid,
         'host' || u || CASE WHEN m = 8 THEN chr(65533) ELSE '' END AS agent,
         list_extract({_SOURCES}, e % 9 + 1) AS src,
         e % 11 <> 0 AS has_data,
         CASE e % 5 WHEN 0 THEN 'NOTICE' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'INFO' ELSE 'NONE' END AS word,
         CASE e % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 6 END AS sev,
         CASE WHEN e % 29 = 0 THEN 'missing_field' WHEN m = 5 THEN 'non_string_field' END AS wdrop,
         CASE WHEN e % 9 = 8 THEN 'no_source' END AS sdrop
  FROM base0),
win AS (SELECT * FROM base WHERE good AND et = 'error'),
f2b AS (SELECT * FROM base WHERE good AND et = 'click'),
sysx AS (
  SELECT *, '<System><Provider Name="Audit &amp; &quot;Co&quot;" Guid="{{g-' || (e % 7) || '}}" /><EventID>' || wid ||
    '</EventID><Version>0</Version><Level>4</Level><Task /><Opcode /><Keywords>0x80&lt;1&gt;</Keywords><TimeCreated SystemTime="'
    || iso || 'Z" /><EventRecordID>' || e || '</EventRecordID><Correlation /><Execution ProcessID="' || (e % 1000) ||
    '" ThreadID="1&#09;2" /><Channel>Security</Channel><Computer>host' || u || '.example</Computer><Security /></System>' AS sx,
    '<EventData><Data Name="TargetUserName">user' || u || '</Data><Data Name="Note">a &amp; b &lt; c &gt; "d"</Data><Data Name="Empty" />'
    || CASE WHEN e % 3 <> 0 THEN '<Data Name="IpAddress">198.51.100.' || (e % 256) || '</Data><Data Name="IpPort">' || (e % 65536) || '</Data>'
            WHEN wid = '4625' THEN '<Data Name="IpAddress">-</Data><Data Name="IpPort">-</Data>' ELSE '' END || '</EventData>' AS ex,
    '<UserData><ServiceShutdown xmlns="http://manifests.microsoft.com/win/2004/08/windows/eventlog" /></UserData>' AS ux,
    CASE WHEN has_data THEN '<UserData><LogFileCleared xmlns="http://manifests.microsoft.com/win/2004/08/windows/eventlog"><SubjectUserName>user'
      || u || '</SubjectUserName><ClientProcessId>' || (e % 1000) || '</ClientProcessId></LogFileCleared></UserData>' ELSE '' END AS cx
  FROM win),
wmsg AS (
  SELECT *, '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">' || sx ||
    CASE WHEN wid = '1100' THEN ux WHEN wid = '1102' THEN cx WHEN has_data THEN ex ELSE '' END || '</Event>' AS raw,
    '{{"win":{{"system":{{"providerName":"Audit & \\"Co\\"","providerGuid":"{{g-' || (e % 7) || '}}","eventID":"' || wid ||
    '","version":"0","level":"4","opcode":"","keywords":"0x80<1>","systemTime":"' || iso || 'Z","eventRecordID":"' || e ||
    '","processID":"' || (e % 1000) || '","threadID":"1\\t2","channel":"Security","computer":"host' || u || '.example"}}' ||
    CASE WHEN NOT has_data THEN '' WHEN wid = '1102' THEN
      ',"logFileCleared":{{"subjectUserName":"user' || u || '","clientProcessId":"' || (e % 1000) || '"}}'
    ELSE ',"eventdata":{{"targetUserName":"user' || u || '","note":"a & b < c > \\"d\\"","empty":""' ||
      CASE WHEN e % 3 <> 0 THEN ',"ipAddress":"198.51.100.' || (e % 256) || '","ipPort":"' || (e % 65536) || '"' ELSE '' END || '}}'
    END || '}}}}' AS data
  FROM sysx WHERE wdrop IS NULL),
smsg AS (
  SELECT *, '<' || (32 + sev) || '> 1 12:00:00,000 [' || (e % 5000) || ']: ' || word || ' [sshd] Ban ' || (e % 256) AS raw,
    CASE WHEN e % 5 = 4 THEN '<' || (32 + sev) || '> 1 12:00:00,000 [' || (e % 5000) || ']: ' || word || ' [sshd] Ban ' || (e % 256)
         ELSE word || ' [sshd] Ban ' || (e % 256) END AS body,
    CASE WHEN e % 4 <> 0 THEN (e % 5000)::VARCHAR END AS pid
  FROM f2b WHERE sdrop IS NULL),
msgs AS (
  SELECT e, 'windows' AS branch, 'windows-xml' AS fmt, aid, u, agent, iso || '+0000' AS wz, wid AS wevent, iso || 'Z' AS wts, raw AS body FROM wmsg
  UNION ALL
  SELECT e, 'fail2ban', 'syslog5424-json', aid, u, agent, iso || '+0000', NULL, NULL, body FROM smsg),
acks AS (
  SELECT *, '1:[' || (u % 1000) || '] (' || agent || ') 10.1.0.' || (u % 250) || '->dfn:{{"integration": "dfn", "alert_id": "' || aid ||
    '", "agent_name": "' || replace(agent, chr(65533), '\\ufffd') || '", "dfn": {{"event_format": "' || fmt || '", "event_id": ' ||
    CASE WHEN wevent IS NULL THEN 'null' ELSE '"' || wevent || '"' END || ', "win_timestamp": ' ||
    CASE WHEN wts IS NULL THEN 'null' ELSE '"' || wts || '"' END || ', "wz_timestamp": "' || wz || '"}}}}' AS line
  FROM msgs),
access AS (
  SELECT event_id AS request_id,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE '10.' || (user_id % 256) || '.0.' || (event_id % 256) END AS peer,
    CASE WHEN event_id % 5 = 0 THEN '192.168.' || (user_id % 256) || '.' || (event_id % 256)
         WHEN event_id % 3 = 0 THEN '2001:db8::' || (event_id % 10)
         WHEN event_id % 7 = 0 THEN '127.0.0.1' ELSE '10.' || (user_id % 256) || '.0.' || (event_id % 256) END AS client,
    event_id, user_id
  FROM events)
"""

_GLOBAL = "CASE e % 9 WHEN 0 THEN n >= 128 WHEN 4 THEN true WHEN 5 THEN true ELSE false END"
_REASON = (
    "CASE WHEN m = 2 THEN 'truncated' WHEN m IN (0, 3) THEN 'invalid_json' END"
)


def _q(select: str) -> str:
    return BASE + select


EXPECTED = {
    "alert_framing": _q("SELECT e AS event_id, true AS framed, CASE WHEN m = 1 THEN 8 ELSE 0 END::BIGINT AS cut FROM base WHERE f"),
    "line_size_guard": "SELECT doc_id, strlen(text) > 2000 AS oversize FROM documents",
    "text_repair": _q("SELECT e AS event_id, m = 8 AS replaced, m = 8 AS has_replacement FROM base WHERE f"),
    "strict_parse": _q(
        f"SELECT e AS event_id, {_REASON} AS reason, m = 8 AS replaced, CASE WHEN good THEN aid END AS alert_id, "
        "CASE WHEN good THEN agent END AS agent_name FROM base WHERE f"
    ),
    "quarantine_records": _q(
        f"SELECT e AS event_id, coalesce({_REASON}, 'replaced') AS reason, true AS has_raw, m = 8 AS repaired "
        "FROM base WHERE f AND m IN (0, 2, 3, 8)"
    ),
    "quarantine_retention": _q(
        f"SELECT e AS event_id, ts, coalesce({_REASON}, 'replaced') AS reason FROM base WHERE m IN (0, 2, 3, 8) "
        "ORDER BY ts DESC, e DESC LIMIT 100"
    ),
    "ingest_stats": _q(
        "SELECT date_trunc('hour', ts) AS interval_start, round(count(*) FILTER (good) / 3600.0::DOUBLE, 9) AS alerts_per_second, "
        "round(CASE WHEN count(*) FILTER (good) > 0 THEN count(*) FILTER (NOT good)::DOUBLE / count(*) FILTER (good) * 100 ELSE 0 END, 6) AS error_rate, "
        "count(*) FILTER (good) AS total_alerts, count(*) FILTER (NOT good) AS error_count, "
        "count(*) FILTER (m = 8) AS replaced_count FROM base WHERE f GROUP BY 1"
    ),
    "keep_latest": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 3000",
    "keep_latest_per_source": (
        "SELECT event_id, ts, event_type FROM events "
        "QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1200"
    ),
    "discarded_counts": (
        "SELECT event_type, least(count(*), 1200)::BIGINT AS kept, greatest(count(*) - 1200, 0)::BIGINT AS discarded "
        "FROM events GROUP BY 1"
    ),
    "relevance_counts": _q(
        "SELECT 'windows' AS branch, count(*) AS selected, count(*) FILTER (wdrop IS NULL) AS messages FROM win UNION ALL "
        "SELECT 'fail2ban', count(*), count(*) FILTER (sdrop IS NULL) FROM f2b"
    ),
    "windows_relevance": _q("SELECT e AS event_id, wid AS windows_id FROM win"),
    "fail2ban_relevance": _q("SELECT e AS event_id, src AS srcip FROM f2b"),
    "alert_relevance": _q(
        "SELECT e AS event_id, et = 'error' AS is_windows, et = 'click' AS is_fail2ban, et IN ('error', 'click') AS is_relevant "
        "FROM base WHERE good"
    ),
    "global_addresses": _q(f"SELECT e AS event_id, {_GLOBAL} AS is_global FROM base"),
    "own_network_filter": _q(
        f"SELECT e AS event_id, CASE WHEN sdrop IS NOT NULL THEN sdrop WHEN NOT ({_GLOBAL}) THEN 'internal_source' END AS drop_reason FROM f2b"
    ),
    "network_allowlist": _q(
        "SELECT request_id, client, CASE WHEN event_id % 5 = 0 THEN user_id % 256 >= 128 WHEN event_id % 3 = 0 THEN event_id % 10 >= 8 "
        "WHEN event_id % 7 = 0 THEN true ELSE user_id % 256 < 128 END AS allowed FROM access"
    ),
    "network_allowlist_table": _q(
        ", nets AS (SELECT DISTINCT s_suppkey % 256 AS b, (s_suppkey * 16) % 256 AS lo FROM supplier) "
        "SELECT request_id, event_id % 7 <> 0 AND EXISTS (SELECT 1 FROM nets WHERE nets.b = a.user_id % 256 "
        "AND a.event_id % 256 - a.event_id % 256 % 16 = nets.lo) AS allowed FROM access a"
    ),
    "network_allowlist_mixed": _q(
        ", n AS (SELECT s_suppkey AS k FROM supplier) SELECT request_id, client, CASE "
        "WHEN client LIKE '10.%' THEN EXISTS (SELECT 1 FROM n WHERE k % 5 = 0 AND k % 256 = a.user_id % 256) OR EXISTS "
        "(SELECT 1 FROM n WHERE k % 5 = 1 AND k % 256 = a.user_id % 256 AND (k * 16) % 256 = a.event_id % 256 - a.event_id % 256 % 16) "
        "WHEN client LIKE '192.168.%' THEN EXISTS (SELECT 1 FROM n WHERE k % 5 = 3 AND k % 256 = a.user_id % 256) "
        "WHEN client LIKE '2001:%' THEN EXISTS (SELECT 1 FROM n WHERE k % 5 = 2 AND k % 10 // 2 = a.event_id % 10 // 2) "
        "ELSE false END AS allowed FROM access a"
    ),
    "windows_system_xml": _q("SELECT e AS event_id, sx AS xml FROM sysx WHERE e % 29 <> 0"),
    "event_data_xml": _q("SELECT e AS event_id, ex AS xml FROM sysx WHERE wid NOT IN ('1100', '1102') AND has_data"),
    "shutdown_user_data": _q("SELECT e AS event_id, ux AS xml FROM sysx WHERE wid = '1100'"),
    "log_cleared_user_data": _q("SELECT e AS event_id, cx AS xml FROM sysx WHERE wid = '1102'"),
    "xml_escaping": (
        "WITH t AS (SELECT page_id, url, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h, "
        "replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS w FROM pages) "
        "SELECT page_id, '<Text>' || h || '</Text>' AS as_text, ' Name=\"' || w || '\" Html=\"' || "
        "replace(replace(replace(replace(h, '\"', '&quot;'), chr(13), '&#13;'), chr(10), '&#10;'), chr(9), '&#09;') || '\"' AS as_attributes FROM t"
    ),
    "windows_messages": _q(
        "SELECT e AS event_id, iso || '+0000' AS sent_timestamp, 'windows-xml' AS event_format, true AS event_forward, "
        f"'{EVENT_SOURCE}' AS event_source, raw AS event_raw, true AS same_body, data FROM wmsg"
    ),
    "windows_rejections": _q("SELECT e AS event_id, wdrop AS drop_reason FROM win WHERE wdrop IS NOT NULL"),
    "syslog_severity": _q("SELECT e AS event_id, sev::INTEGER AS severity, (32 + sev)::INTEGER AS priority FROM f2b"),
    "syslog_event_raw": _q("SELECT e AS event_id, raw AS event_raw, body FROM smsg"),
    "syslog_messages": _q(
        "SELECT e AS event_id, iso || '+0000' AS sent_timestamp, 'syslog5424-json' AS event_format, agent AS \"hostName\", "
        "'' AS \"structuredData\", 'fail2ban.actions' AS \"appName\", 'fail2ban.actions' AS \"appInst\", pid AS \"procId\", "
        "'4' AS facility, (32 + sev)::INTEGER AS priority, sev::INTEGER AS severity FROM smsg"
    ),
    "message_dispatch": _q("SELECT e AS event_id, branch, fmt AS event_format, length(body)::BIGINT AS body_chars FROM msgs"),
    "client_address": _q("SELECT request_id, client FROM access"),
    "message_values": _q(
        "SELECT e AS event_id, '{\"timestamp\":\"' || iso || '+0000\",\"event_format\":\"windows-xml\",\"event_forward\":true,"
        f"\"event_parser\":\"{EVENT_PARSER}\",\"event_source\":\"{EVENT_SOURCE}\",\"event_raw\":' || to_json(raw) || ',\"body\":' || to_json(raw) || "
        "',\"data\":' || data || '}' AS value FROM wmsg UNION ALL "
        "SELECT e, '{\"timestamp\":\"' || iso || '+0000\",\"event_format\":\"syslog5424-json\",\"event_forward\":true,"
        f"\"event_parser\":\"{EVENT_PARSER}\",\"event_source\":\"{EVENT_SOURCE}\",\"event_raw\":' || to_json(raw) || ',\"body\":' || to_json(body) || "
        "',\"hostName\":' || to_json(agent) || ',\"structuredData\":\"\",\"appName\":\"fail2ban.actions\",\"appInst\":\"fail2ban.actions\"' || "
        "CASE WHEN pid IS NULL THEN '' ELSE ',\"procId\":\"' || pid || '\"' END || ',\"facility\":\"4\",\"priority\":' || (32 + sev) || "
        "',\"severity\":' || sev || '}' FROM smsg"
    ),
    "kafka_records": _q(
        "SELECT e AS event_id, 'customer-1' AS topic, raw AS event_raw FROM wmsg UNION ALL SELECT e, 'customer-1', raw FROM smsg"
    ),
    "acknowledgements": _q(
        "SELECT e AS event_id, 'dfn' AS integration, aid AS alert_id, agent AS agent_name, fmt AS event_format, wevent AS alert_event_id, "
        "wts AS win_timestamp, wz AS alert_timestamp FROM msgs"
    ),
    "ack_lines": _q("SELECT e AS event_id, line FROM acks"),
    "oversize_acks": _q("SELECT e AS event_id, length(line) > 190 AS oversize FROM acks"),
    "incident_errors": _q(
        "SELECT e AS event_id, d AS description, '1:dfn:{\"error\": 503, \"description\": \"' || replace(d, chr(65533), '\\ufffd') || "
        "'\", \"integration\": \"dfn\"}' AS line FROM (SELECT e, 'Incomplete Windows alert. No eventdata found. alert_id: ' || aid || "
        "', agent_id: ' || (u % 1000) || ', agent_name: ' || agent AS d FROM wmsg WHERE NOT has_data AND wid NOT IN ('1100', '1102'))"
    ),
    "outgoing_records": _q(
        f", own AS (SELECT *, CASE WHEN sdrop IS NOT NULL THEN sdrop WHEN NOT ({_GLOBAL}) THEN 'internal_source' END AS d FROM f2b), "
        "sent AS (SELECT e, 'windows' AS branch FROM wmsg UNION ALL SELECT e, 'fail2ban' FROM own WHERE d IS NULL) "
        "SELECT e AS event_id, 'message' AS stream, branch, NULL AS reason FROM sent UNION ALL SELECT e, 'ack', branch, NULL FROM sent UNION ALL "
        "SELECT e, 'error', 'windows', NULL FROM wmsg WHERE NOT has_data AND wid NOT IN ('1100', '1102') UNION ALL "
        "SELECT e, 'rejected', 'windows', wdrop FROM win WHERE wdrop IS NOT NULL UNION ALL "
        "SELECT e, 'rejected', 'fail2ban', d FROM own WHERE d IS NOT NULL UNION ALL "
        f"SELECT e, 'quarantine', 'quarantine', coalesce({_REASON}, 'replaced') FROM base WHERE f AND m IN (0, 2, 3, 8)"
    ),
}

_VALUES = EXPECTED["message_values"].removeprefix(BASE)
_ERRORS = EXPECTED["incident_errors"].removeprefix(BASE)

STREAM = _q(
    f"SELECT 'message' AS stream, value FROM ({_VALUES}) UNION ALL SELECT 'ack', line FROM acks "
    f"UNION ALL SELECT 'error', line FROM ({_ERRORS})"
)
