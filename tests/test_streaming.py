"""Streams give what the batch operators give."""

from __future__ import annotations

import json
import random
import os
import tracemalloc
import uuid
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.operators import requests, telemetry
from alertloom.plans import alert_plan
from alertloom.plans.alert_plan import AlertJob
from alertloom.sources import tail
from alertloom.sources.alert_files import alert_lines
from alertloom.sources.tail import alert_tail_stream
from alertloom.streaming import alert_stream, correctable, rate_limit_stream, telemetry_stream
from tests.fixtures import fail2ban, windows

START = datetime(2024, 1, 1)


def _segments(folder):
    folder.mkdir()
    for i in range(4):
        alerts = [fail2ban(i), windows("4625", eventdata={"a": str(i)}), windows("4719"), windows("4624", eventdata={})]
        text = "\n".join(json.dumps(a) for a in alerts) + '\n{"timestamp": broken}\n'
        (folder / f"segment-{i}.json").write_text(text)
    return str(folder)


def test_alert_stream_equals_batch(spark, tmp_path):
    folder = _segments(tmp_path / "in")
    name = f"alerts-{uuid.uuid4()}"
    job = AlertJob("customer", prefix='{"timestamp"')
    out = {n: alert_stream.folder_sink(str(tmp_path / n)) for n in ("messages", "replies", "dead")}
    for _ in range(2):  # the second start finds nothing new
        query = alert_stream.start(
            spark, folder, job, name, out["messages"], out["replies"], out["dead"], once=True, files_per_batch=2,
            base=str(tmp_path / "state"),
        )
        query.awaitTermination()
    batch = alert_plan.records(alert_lines(spark, folder), job)
    expect = lambda *names: sorted(r.value or "" for r in batch.where(F.col("stream").isin(*names)).collect())
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert sorted(r.value for r in read("messages").collect()) == expect("message")
    assert sorted(r.value for r in read("replies").collect()) == expect("ack", "error")
    dead = read("dead")
    assert dead.count() == len(expect("rejected", "quarantine")) == 4
    assert len(expect("message")) == 12 and len(expect("error")) == 4
    assert read("messages").select("batch").distinct().count() == 2


def test_interval_stream_equals_batch(spark, tmp_path):
    rows = [("t", START + timedelta(seconds=37 * i), i, (i * 7919) % 3_000_000, {"send": i}) for i in range(400)]
    schema = "topic string, ts timestamp, seq long, elapsed_us long, stages map<string,bigint>"
    df = spark.createDataFrame(rows, schema)
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("t", START + timedelta(days=9), 9999, 1, {})], schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    result = telemetry_stream.sink_intervals(stream, ["topic"])
    telemetry_stream.store(result, f"intervals-{uuid.uuid4()}", str(tmp_path / "out"), once=True, base=str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("max_stages").collect()
    want = telemetry.sink_intervals(df, ["topic"]).drop("max_stages").collect()
    assert sorted(got) == sorted(want) and len(got) > 20


def test_worker_and_ingest_streams_are_accepted(spark, tmp_path):
    schema = "worker string, ts timestamp, seq long, alert_id string, elapsed_us long, reason string, replaced boolean"
    rows = [("w", START + timedelta(seconds=i), i, f"a{i}", i, None if i % 5 else "invalid_json", False) for i in range(2000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for n, form in enumerate((telemetry_stream.worker_intervals, telemetry_stream.ingest_stats)):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{n}")
        telemetry_stream.store(form(stream, ["worker"]), f"s-{uuid.uuid4()}", out, once=True, base=str(tmp_path)).awaitTermination()
        counts = [sum(v for k, v in r.asDict().items() if k in ("alerts_processed", "total_alerts", "error_count")) for r in spark.read.parquet(out).collect()]
        assert counts == [600, 600]


def test_rate_limit_stream_with_late_requests(spark, tmp_path):
    """A late file's accepted times are kept in order: the oldest leaves the window first."""
    schema = "client string, request_id long, request_ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for seconds in ([30], [10], [75, 85, 95]):
        rows = [("a", s, datetime(2024, 1, 1, 0, s // 60, s % 60)) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        decided = rate_limit_stream.rate_limit(spark.readStream.schema(schema).parquet(source), 2, 60)
        query = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["request_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    # At 75 the request of 10 is out of the window, at 85 those of 30 and 75 fill it, at 95 only 75 is left.
    assert got == {30: True, 10: True, 75: True, 85: False, 95: True}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(f"c{i % 3}", START + timedelta(seconds=4 * i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "client string, request_ts timestamp, request_id long")
    for part in range(3):
        df.where(F.floor(F.col("request_id") / 100) == part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
    decided = rate_limit_stream.rate_limit(stream, 2, 60)
    query = (
        decided.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    columns = ["client", "request_id", "accepted", "remaining", "reset_at"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    assert sorted(got) == sorted(requests.rate_limit(df, 2, 60).select(columns).collect())


class _Captured:
    """Takes the place of a request stream and of a client's state, so that the decisions run here."""

    exists, value = False, None

    def groupBy(self, _):
        return self

    def applyInPandasWithState(self, decide, *_):
        return decide

    def update(self, value):
        self.value = value


def test_rate_limit_stream_memory_does_not_grow_with_a_client(monkeypatch):
    """Ten thousand rows a batch, shuffled: sorted runs are merged, and frames come out by and by."""
    monkeypatch.setattr(rate_limit_stream, "RUN_ROWS", 30_000, raising=False)
    monkeypatch.setattr(rate_limit_stream, "BLOCK_ROWS", 1000, raising=False)
    decide = rate_limit_stream.rate_limit(_Captured(), 3, 60)

    def batches(n):
        for k in range(n):
            at = (np.arange(10_000) * n + k) * 7919 % (10_000 * n)
            yield pd.DataFrame({"client": "hot", "request_id": -at, "request_ts": pd.to_datetime(at // 3 * 5, unit="s")})

    def run(n, taken):
        state = _Captured()
        for frame in decide(("hot",), batches(n), state):
            taken(frame)
        return state

    frames = []
    run(8, frames.append)
    got, times = pd.concat(frames), []
    assert got["request_id"].tolist() == [-(k // 3 * 3 + 2 - k % 3) for k in range(79_998)] + [-79_999, -79_998]
    for now, ok, left, reset in zip(got["request_ts"], got["accepted"], got["remaining"], got["reset_at"]):
        times = [t for t in times if t > now - timedelta(seconds=60)]
        assert ok == (len(times) < 3)
        times += [now] if ok else []
        assert (left, reset) == (3 - len(times), times[0] + timedelta(seconds=60))
    assert got["accepted"].sum() == -(-26_667 // 12) * 3
    peaks = []
    for n in (8, 32):
        tracemalloc.start()
        run(n, lambda _: None)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] + 2_000_000


def test_rate_limit_stream_orders_rows_without_a_time_or_id_last():
    times = [pd.Timestamp(2024, 1, 1, 0, 0, s) for s in (3, 1, 3, 2)] + [pd.NaT]
    frame = pd.DataFrame({"request_ts": times, "request_id": [None, 2**53 - 1, 4, 5, 6]})
    for rows in (1, 2, 100):
        got = rate_limit_stream._time_order(rows, 2)(frame[k : k + 1] for k in range(5))
        assert [(n, i) for block in got for _, _, n, i in block.tolist()] == [(0, 2**53 - 1), (0, 5), (0, 4), (1, 0), (0, 6)]


def test_tail_follows_growth_and_rotation(spark, tmp_path):
    path = tmp_path / "alerts.json"
    path.write_bytes(b'{"id":0}\n')

    def drain():
        lines = alert_tail_stream(spark, str(path)).select("line")
        writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.line for r in spark.read.schema("line string").parquet(str(tmp_path / "out")).collect())

    (tmp_path / "out").mkdir()
    assert drain() == []
    with path.open("ab") as file:
        file.write(b'{"id":1}\r\n{"id":2}\r{"id":3}\n{"id":4')
    assert drain() == ['{"id":1}', '{"id":2}', '{"id":3}']
    with path.open("ab") as file:
        file.write(b'4}\n{"id":5}\n')
    path.rename(tmp_path / "alerts.json.1")
    path.write_bytes(b'{"id":6}\n')
    assert drain() == ['{"id":1}', '{"id":2}', '{"id":3}', '{"id":44}', '{"id":5}', '{"id":6}']


def test_tail_pieces_cut_at_lines(tmp_path, monkeypatch):
    path = tmp_path / "a"
    lines = [b"x" * n for n in (3, 0, 9, 1, 30, 2)]
    path.write_bytes(b"\n".join(lines) + b"\n")
    size = path.stat().st_size
    for piece in range(1, size + 1):
        monkeypatch.setattr(tail, "PIECE_BYTES", piece)
        reader = tail.AlertTailReader(str(path), True)
        end = {"inode": path.stat().st_ino, "position": size}
        pieces = reader.partitions({**end, "position": 0}, end)
        assert _lines(reader, pieces) == lines


def _lines(reader, pieces):
    return [line for p in pieces for batch in reader.read(p) for line in batch.column("line").to_pylist()]


def test_tail_replays_a_planned_batch_after_a_rotation(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"1\n2\n3\n")
    reader = tail.AlertTailReader(str(path), True)
    start, end = reader.initialOffset(), reader.latestOffset()
    planned = reader.partitions(start, end)
    path.rename(tmp_path / "a.1")
    path.write_bytes(b"4\n")
    assert _lines(reader, planned) == _lines(reader, reader.partitions(start, end)) == [b"1", b"2", b"3"]
    assert _lines(reader, reader.partitions(end, reader.latestOffset())) == [b"4"]


def test_tail_reads_files_of_two_rotations_and_misses_none(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"1\n")
    reader = tail.AlertTailReader(str(path), True)
    start = reader.latestOffset()
    for number, text in ((1, b"2\n"), (2, b"3\n4\n")):
        path.rename(tmp_path / f"a.{number}")
        path.write_bytes(text)
        os.utime(path, ns=(0, os.stat(tmp_path / f"a.{number}").st_mtime_ns + 1_000_000))
    end = reader.latestOffset()
    assert _lines(reader, reader.partitions(start, end)) == [b"2", b"3", b"4"]
    (tmp_path / "a.2").rename(tmp_path / "a.2.gz")
    with pytest.raises(FileNotFoundError):
        reader.partitions(start, end)
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "a.1").rename(tmp_path / "elsewhere" / "a.1")
    with pytest.raises(FileNotFoundError):
        reader.partitions(start, end)


def test_open_and_stored_intervals_together_are_all(spark):
    schema = "k string, interval_start int, n int"
    stored = spark.createDataFrame([("a", 1, 5), (None, 1, 6)], schema)
    every = spark.createDataFrame([("a", 1, 5), (None, 1, 6), ("a", 2, 7), (None, 2, 8)], schema)
    assert sorted(telemetry_stream.completed(stored, every, ["k"]).collect(), key=str) == sorted(every.collect(), key=str)


OPERATIONS = "topic string, ts timestamp, seq long, elapsed_us long, stages map<string,bigint>"


def _operations(n):
    rng = random.Random(6)
    rows = [(rng.choice(["t", "u", None]), START + timedelta(seconds=37 * i), i, (i * 7919) % 3_000_000 // 500_000 * 500_000, {"send": i}) for i in range(n)]
    rng.shuffle(rows)
    return rows


def _partials(rows):
    return telemetry.sink_partials(rows, ["topic"])


def _merged(partials):
    return telemetry.merged_partials(partials, ["topic"])


def _plain(intervals):
    return sorted(map(str, intervals.collect()))


def test_late_rows_correct_their_intervals(spark, tmp_path):
    """Shuffled files, hours apart: every interval is that of all rows, also after a replay and after compactions."""
    rows = _operations(4900)
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(7):
        spark.createDataFrame(rows[700 * k : 700 * k + 700], OPERATIONS).coalesce(1).write.mode("append").parquet(source)
    want = telemetry.sink_intervals(spark.createDataFrame(rows, OPERATIONS), ["topic"])
    assert want.count() > 300
    stream = spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", 1).parquet(source)
    correctable.store(stream, table, str(tmp_path / "progress"), _partials, ["topic"], once=True).awaitTermination()
    assert _plain(correctable.sink_intervals(spark, table, ["topic"])) == _plain(want)
    # The last batch runs again, as after a crash.
    again = spark.createDataFrame(rows[:700], OPERATIONS)
    correctable.adder(table, _partials, ["topic"])(again, 9)
    correctable.adder(table, _partials, ["topic"])(again.limit(0), 9)
    assert _plain(correctable.sink_intervals(spark, table, ["topic"])) == _plain(want)
    assert [correctable.compact(spark, table, _merged, keep) for keep in (5, 5, 2, 0)] == [2, 2, 5, 9]
    assert _plain(correctable.sink_intervals(spark, table, ["topic"])) == _plain(want)
    assert correctable.late_rows(spark, table).count() == 0
    assert correctable._folders(spark, f"{table}/compacted", "upto") == [5, 9]


def test_rows_after_the_retention_are_counted(spark, tmp_path):
    table = str(tmp_path / "table")
    add = correctable.adder(table, _partials, ["topic"], "2 hours")
    at = lambda hours, seq: ("t", None if hours is None else START + timedelta(hours=hours), seq, 5, {})
    for number, hours in enumerate([[5, 1], [4, 3, 2.9, None], [2, 9]]):
        add(spark.createDataFrame([at(h, 10 * number + k) for k, h in enumerate(hours)], OPERATIONS), number)
    late = correctable.late_rows(spark, table).collect()
    assert sorted((r.ts is None, r.ts and (r.ts - START).total_seconds() / 3600, r.rows) for r in late) == [(False, 2.0, 1), (False, 2.9, 1), (True, None, 1)]
    assert correctable.sink_intervals(spark, table, ["topic"]).agg(F.sum("operations")).head()[0] == 5
