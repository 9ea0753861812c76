"""Small alerts with the shapes of the two supported sources."""

from __future__ import annotations

import copy


def fail2ban(number: int = 2, severity: str | None = "NOTICE", program: str = "fail2ban.actions", action: str = "Ban"):
    data = {"srcip": f"198.51.100.{number}", "actiontaken": action, "service": "sshd", "program_name": program, "pid": "40417"}
    if severity is not None:
        data["severity"] = severity
    return {
        "timestamp": "2031-05-17T08:42:13.250+0000",
        "agent": {"ip": "10.44.7.19", "name": "edge-mail", "id": "731"},
        "data": data,
        "rule": {"level": 5, "groups": ["syslog", "fail2ban"], "id": "77120"},
        "id": f"55.{number}",
        "full_log": f"fail2ban: 2031-05-17 08:42:13,250 {program} [40417]: {severity} [sshd] {action} 198.51.100.{number}",
    }


def windows(event_id: str = "4625", **parts):
    system = {
        "providerName": "Auditing", "providerGuid": "{a17c}", "eventID": event_id, "version": "0", "level": "0",
        "task": "271", "opcode": "0", "keywords": "0x80", "systemTime": "2031-05-17T08:42:13.250Z",
        "eventRecordID": "900017", "processID": "3312", "threadID": "45", "channel": "Security", "computer": "desk-west.example",
    }
    win = {"system": system}
    win.update(copy.deepcopy(parts))
    return {
        "timestamp": "2031-05-17T08:42:13.250+0000",
        "agent": {"id": "418", "ip": "10.44.9.3", "name": "desk-west"},
        "data": {"win": win},
        "id": "55.601",
        "rule": {"groups": ["windows"]},
    }
