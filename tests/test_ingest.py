"""Framing, decoding, strict parsing and quarantine against Python's own rules."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from alertloom.operators import ingest
from alertloom.sources.alert_files import alert_lines


def _damaged(rng):
    base = '{"timestamp":"t","a":[1,2,{"b":"x\\"}]"}],"c":null,"n":-1.5e3}'
    kind = rng.randrange(6)
    if kind == 0:
        return base
    at = rng.randrange(13, len(base))
    if kind == 1:
        return base[:at]
    if kind == 2:
        return base + rng.choice([" x", "]", "}", ",", '{"timestamp"', "]x", "  ", "\t", ',"s":1}', " ", "//"])
    if kind == 3:
        return base[:at] + rng.choice(['"', "}", "]", ",", "\\", "\x01", "1", ":"]) + base[at:]
    if kind == 4:
        return base[:at] + base[at + 1 :]
    return base[:at] + rng.choice('{}[]",:0tfn') + base[at + 1 :]


def _is_json(text):
    try:
        json.loads(text.rstrip())
        return True
    except ValueError:
        return False


def test_strict_parse_agrees_with_json_loads(spark):
    rng = random.Random(7)
    lines = sorted({_damaged(rng) for _ in range(4000)} - {""})
    lines = [x for x in lines if x.startswith('{"timestamp"') and "}" in x[13:]]
    parsed = ingest.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    got = {r.line: r.reason is None for r in parsed.select("line", "reason").collect()}
    assert len(got) > 500 and got == {x: _is_json(x) for x in lines}


def test_bytes_on_disk(spark, tmp_path):
    good = b'{"timestamp":"1","k":"v"}'
    content = (
        good + b"\r\n" + b'junk {"timestamp":"2"}\n' + b'{"timestamp":"3","v":"\xff\xfe"}\r' + b"no prefix\n"
        + b'{"timestamp":"4"\n' + b'{"timestamp":"5"} tail\n' + b'{"timestamp":"6","v":"' + b"x" * 131072 + b'"}\n'
        + b'{"timestamp":"7","v":"' + b"y" * 20000 + b'"}\n' + b'{"timestamp":"8\xff}\n'
    )
    (tmp_path / "alerts.json").write_bytes(content)
    parsed = ingest.parse_lines(alert_lines(spark, str(tmp_path))).cache()
    rows = {r.t or r.line[:15]: (r.reason, r.replaced) for r in parsed.select(
        F.try_variant_get("alert", "$.timestamp", "string").alias("t"), "line", "reason", "replaced").collect()}
    assert rows == {
        "1": (None, False), "2": (None, False), "3": (None, True), '{"timestamp":"4': ("truncated", False),
        '{"timestamp":"5': ("invalid_json", False), '{"timestamp":"6': ("oversize", False), "7": (None, False),
        '{"timestamp":"8': ("invalid_utf8", True),
    }
    stored = {bytes(r.raw)[13:15]: (r.reason, r.replaced_text) for r in ingest.quarantine(parsed).collect()}
    assert stored[b'"3'] == ("replaced", '{"timestamp":"3","v":"��"}')
    assert len(stored) == 5 and stored[b'"8'][0] == "invalid_utf8"


def test_ingest_stats_counts(spark):
    rows = [(None, i < 10) for i in range(100)] + [("invalid_json", False)] * 5
    df = spark.createDataFrame(rows, "reason string, replaced boolean").withColumn("ts", F.lit("2024-01-01 00:03:00").cast("timestamp"))
    r = ingest.ingest_stats(df, "ts").head()
    assert (r.total_alerts, r.error_count, r.replaced_count, r.error_rate) == (100, 5, 10, 5.0)
    only_errors = df.where("reason is not null")
    assert ingest.ingest_stats(only_errors, "ts").head().error_rate == 0.0


def test_newest_matches_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    order = lambda r: (r[0] or "", *r[1:])
    for n in (0, 7, 1500, 9000):
        expected = sorted(rows, key=lambda r: (r[1], r[2]))[len(rows) - min(n, len(rows)) :]
        assert sorted(map(tuple, ingest.keep_latest(df, ["t", "i"], n).collect()), key=order) == sorted(expected, key=order)
        per_key = [r for k in ("a", None) for r in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))[::-1][:n]]
        assert sorted(map(tuple, ingest.keep_latest(df, ["t", "i"], n, ["k"]).collect()), key=order) == sorted(per_key, key=order)
