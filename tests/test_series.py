"""Series cut into parts and the rate limit against plain loops, with a hot key and small parts."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.operators import requests, series

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for i in range(1200):
        at += rng.choice([0, 1, 5, 30, 400, 9000])
        rows.append((rng.choice(["hot", "hot", "a", None]), START + timedelta(seconds=at), i, rng.choice([None, *range(9)])))
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, seq long, v int")


def _by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def test_trailing_carry_and_count(samples):
    rows, df = samples
    args = (["k"], ["ts", "seq"])
    got = series.trailing(df, *args, F.coalesce("v", F.lit(-1)), 5, "last5", 60)
    got = series.carry_forward(got, *args, F.col("v"), "carried", 60)
    got = {r.seq: r for r in series.running_count(got, *args, F.col("v") > 4, "n", 60).collect()}
    for group in _by_key(rows).values():
        carried, n, last = None, 0, []
        for _, _, seq, v in group:
            carried = v if v is not None else carried
            n += v is not None and v > 4
            last = [*last, -1 if v is None else v][-5:]
            assert (got[seq].carried, got[seq].n, got[seq].last5) == (carried, n, last)


def test_unknown_samples_do_not_depend_on_parts(spark, samples):
    rows, df = samples
    found = []
    for part_rows in (1, 60, 10_000_000):
        got = series.trailing(df, ["k"], ["ts", "seq"], F.col("v"), 3, "last3", part_rows)
        found.append({r.seq: r.last3 for r in got.collect()})
    assert found[0] == found[1] == found[2]
    for group in _by_key(rows).values():
        for at, r in enumerate(group):
            assert found[0][r[2]] == [v for *_, v in group[max(0, at - 2) : at + 1]]
    resources = df.select("k", "ts", "seq", (F.col("v") * 10.0).alias("cpu_percent"))
    sinks = df.select("k", "ts", "seq", (F.col("v") * 1.0).alias("ops_per_sec")).where("k IS NOT NULL")
    by_part = [sorted(series.throughput_cpu_correlation(resources, sinks, ["k"], s).collect(), key=str) for s in (60, 100_000)]
    assert by_part[0] == by_part[1] and all(r.correlated is not None and r.anomaly is not None for r in by_part[0])


def test_series_without_keys(samples):
    rows, df = samples
    got = {r.seq: r.n for r in series.running_count(df, [], ["ts", "seq"], F.col("v").isNull(), "n", 60).collect()}
    n = 0
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        n += r[3] is None
        assert got[r[2]] == n


def test_outages_and_mode(samples):
    rows, df = samples
    polls = df.withColumn("connected", F.coalesce(F.col("v") < 5, F.lit(False)))
    got = sorted((r.k or "", r.outage_start, r.last_skipped, r.restored_at, r.skipped_polls) for r in series.outages(polls, ["k"], 60).collect())
    expected = []
    for k, group in _by_key(rows).items():
        run = []
        for _, ts, _, v in [*group, (k, None, None, 0)]:
            if v is not None and v < 5:
                if run:
                    expected.append((k or "", run[0], run[-1], ts, len(run)))
                run = []
            else:
                run.append(ts)
    assert got == sorted(expected, key=lambda r: (r[0], r[1], r[2]))
    queues = df.select("k", "ts", "seq", (F.coalesce("v", F.lit(6)) * 12).alias("size"), F.lit(100).alias("capacity"))
    modes = {r.seq: r.high_throughput for r in series.high_throughput_mode(queues, ["k"], part_rows=60).collect()}
    for group in _by_key(rows).values():
        mode = False
        for _, _, seq, v in group:
            fill = (6 if v is None else v) * 12
            mode = True if fill > 80 else False if fill < 50 else mode
            assert modes[seq] == mode


@pytest.mark.parametrize(("limit", "window", "gaps"), [(1, 10, [0, 1, 3, 40]), (3, 60, [0, 1, 20, 70]), (5, 7, [0, 1, 1, 2, 900])])
def test_rate_limit_is_the_sequential_rule(spark, limit, window, gaps):
    rng = random.Random(limit)
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice(gaps)
        rows.append((rng.choice(["hot", "hot", "x", None]), START + timedelta(seconds=at), i))
    df = spark.createDataFrame(rows, "client string, request_ts timestamp, request_id long").repartition(7)
    got = {r.request_id: (r.accepted, r.remaining, r.reset_at) for r in requests.rate_limit(df, limit, window).collect()}
    kept = defaultdict(list)
    for client, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        times = kept[client] = [t for t in kept[client] if t > ts - timedelta(seconds=window)]
        ok = len(times) < limit
        if ok:
            times.append(ts)
        assert got[i] == (ok, limit - len(times), times[0] + timedelta(seconds=window))


def test_rate_limit_zero_accepts_nothing(spark):
    df = spark.createDataFrame([("a", START, 1)], "client string, request_ts timestamp, request_id long")
    assert requests.rate_limit(df, 0, 60).head()[3:] == (False, 0, START)


# Parts


@pytest.mark.parametrize("time", ["timestamp'2024-01-01'", "CAST(NULL AS timestamp)", "timestamp_seconds(1704067200 + id % 60)"])
def test_a_burst_is_cut_into_equal_parts(spark, time):
    """400,000 rows of one key within a minute, a moment, or without a time."""
    rows = spark.range(400_000).selectExpr("'hot' AS k", f"{time} AS ts", "(id * 7919) % 400000 AS seq", "CAST(id % 5 AS double) AS v")
    sizes = sorted(r["count"] for r in series._parted(rows, ["k"], ["ts", "seq"], None).groupBy("_part").count().collect())
    assert len(sizes) >= 24 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    counted = series.running_count(rows, ["k"], ["ts", "seq"], F.lit(True), "n")
    assert counted.agg(F.count_distinct("n"), F.min("n"), F.max("n")).head()[:3] == (400_000, 1, 400_000)


def test_small_keys_share_parts_and_results_do_not_depend_on_them(spark, samples):
    _, df = samples
    found = [sorted(map(str, series.carry_forward(df, ["k"], ["ts", "seq"], F.col("v"), "c", n).collect())) for n in (1, 7, 100_000)]
    assert found[0] == found[1] == found[2]
    many = spark.range(5000).selectExpr("CAST(id AS string) AS k", "current_timestamp() AS ts", "id AS seq", "id AS v")
    assert series.carry_forward(many, ["k"], ["ts", "seq"], F.col("v"), "c").where("c = v").count() == 5000
    empty = series.trailing(df.limit(0), ["k"], ["ts", "seq"], F.col("v"), 3, "last3")
    assert empty.count() == 0


def _moments(rng, hosts, n, late):
    at = [None if rng.random() < late else START + timedelta(seconds=rng.choice([0, 0, 5, 5, 9, 700, 701])) for _ in range(n)]
    return [(rng.choice(hosts), t, k) for k, t in enumerate(at)]


@pytest.mark.parametrize("part_rows", [1, 40, None])
def test_merge_of_two_series_is_the_loop(spark, part_rows):
    """Ties in time, rows without a time, hosts that one side lacks, and parts without a row of the other side."""
    rng = random.Random(8)
    left = [(h, rng.choice(["w1", "w2", None]), t, k, rng.choice([None, 1.0, 5.0, 9.0])) for h, t, k in _moments(rng, ["a", "a", "a", "b", None], 400, 0.1)]
    right = [(h, t, k, rng.choice([None, 2.0, 4.0])) for h, t, k in _moments(rng, ["a", "b", "c", None], 60, 0.1)]
    frames = (
        spark.createDataFrame(left, "host string, worker string, ts timestamp, seq long, rate double"),
        spark.createDataFrame(right, "host string, ts timestamp, seq long, memory double"),
    )
    found = series.merged_trailing(*frames, ["host"], ["worker"], F.col("rate"), F.col("memory"), 3, part_rows).collect()
    got = {r.seq: (r._own, r._other) for r in found}
    moment = lambda t: (t is not None, t or START)
    assert len(found) == len(left)
    for h, w, t, k, _ in left:
        own = sorted(((moment(x[2]), x[3], x[4]) for x in left if x[:2] == (h, w) and (moment(x[2]), x[3]) <= (moment(t), k)), key=lambda x: x[:2])
        other = sorted(((moment(x[1]), x[2], x[3]) for x in right if x[0] == h and moment(x[1]) <= moment(t)), key=lambda x: x[:2])
        assert got[k] == ([v for *_, v in own][-3:], [v for *_, v in other][-3:] or None)


def test_merge_reads_each_side_once_and_shuffles_rows_once(spark, tmp_path):
    schema = "host string, ts timestamp, seq long, cpu_percent double, ops_per_sec double"
    for side in ("left", "right"):
        spark.createDataFrame([("a", START, k, 1.0, 1.0) for k in range(50)], schema).write.parquet(str(tmp_path / side))
    sides = [spark.read.parquet(str(tmp_path / side)) for side in ("left", "right")]
    found = series.throughput_cpu_correlation(*sides, ["host"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # What the two readers of the shuffled rows need is read and shuffled once.
    assert plan.count("FileScan parquet") == 2 and plan.count("ReusedExchange") == 1
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") == 1
