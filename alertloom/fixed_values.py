"""Values that consumers of the messages depend on and that must not vary.

Fixed values: message field contents, monitored ids, thresholds and network
tables.  They are stated as they appear on the wire.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- message fields ---------------------------------------------------------
EVENT_FORMAT_WINDOWS = "windows-xml"
EVENT_FORMAT_SYSLOG = "syslog5424-json"
EVENT_PARSER = "wazuh"  # literal wire value that receivers dispatch on
EVENT_SOURCE = "soc-agent"
SYSLOG_FACILITY = 4
ACK_INTEGRATION = "dfn"  # default integration name of acknowledgement lines
ACK_DETAIL_FIELD = "dfn"
ERROR_CODE = 503

# --- alert framing ----------------------------------------------------------
ALERT_PREFIX = '{"timestamp"'
ALERT_SUFFIX = "}"
MAX_LINE_BYTES = 131072
MAX_ACK_CHARS = 65535
QUEUE_BOUND = 100_000
FAILED_ALERTS_KEPT = 100

# --- Windows events ---------------------------------------------------------
MONITORED_EVENT_IDS = (
    "4625", "4719", "4964", "1102", "4794", "4724", "4697",
    "4702", "4698", "4672", "4720", "1100", "3697",
)
EVENT_IDS_WITH_ADDRESS_DEFAULTS = ("4625", "4771", "4768")
EVENT_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"
EVENTLOG_NAMESPACE = "http://manifests.microsoft.com/win/2004/08/windows/eventlog"

# --- fail2ban ---------------------------------------------------------------
FAIL2BAN_PROGRAM = "fail2ban.actions"
FAIL2BAN_GROUP = "fail2ban"
SYSLOG_SEVERITY = {"NOTICE": 5, "WARNING": 4, "ERROR": 3}
SYSLOG_DEFAULT_SEVERITY = 6

# --- addresses that are not globally reachable (IANA special registries) ----
IPV4_PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
)
IPV4_SHARED = "100.64.0.0/10"  # not global, but global in IPv4-mapped IPv6 form
IPV4_GLOBAL_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
IPV6_NOT_GLOBAL = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
    "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
IPV6_GLOBAL_EXCEPTIONS = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
)
LOCALHOST_ONLY = frozenset({"127.0.0.1", "::1"})

# --- text characters that a trailing strip removes --------------------------
STRIPPED_CHARACTERS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class Thresholds:
    """Limits of the classifiers; pass a changed copy to an operator to override."""

    queue_warning_pct: float = 70.0
    queue_critical_pct: float = 90.0
    queue_high_throughput_pct: float = 80.0
    queue_recovery_pct: float = 50.0
    worker_stall_seconds: float = 60.0
    worker_slow_seconds: float = 2.0
    worker_extremely_slow_seconds: float = 10.0
    worker_slow_share_pct: float = 20.0
    sink_slow_seconds: float = 1.0
    sink_extremely_slow_seconds: float = 5.0
    service_latency_seconds: float = 30.0
    service_error_warning_pct: float = 5.0
    service_error_critical_pct: float = 15.0
    cpu_warning_pct: float = 80.0
    cpu_critical_pct: float = 95.0
    memory_warning_pct: float = 85.0
    memory_critical_pct: float = 95.0
    open_files_warning_pct: float = 80.0
    open_files_critical_pct: float = 95.0


THRESHOLDS = Thresholds()
