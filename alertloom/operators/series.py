"""Ordered series: trailing values, as-of matches, hysteresis, outages.

A key may own a third of all rows, a burst may hold all rows of a key in one second, and
rows may lack a time; so no operator here sorts one key's rows in one task.  Rows are cut
into parts of equal depth along (key, order) (see ``ordered``) and ordered inside a part;
what a part needs from the rows before it (last value, running count, last few rows) comes
from a summary with one row per key and part, which is carried along the key and joined back.
``part_rows`` asks for parts of that size; without it the session's shuffle partitions decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.times import micros
from alertloom.operators import ranking
from alertloom.operators.keys import key_text
from alertloom.operators.ordered import part_of
from alertloom.operators.telemetry import fill_pct


def _place(order: list[str]) -> list[Column]:
    return [F.col("_key"), *[micros(c) if c == "ts" else F.col(c) for c in order]]


def _parted(df: DataFrame, keys: list[str], order: list[str], part_rows: int | None) -> DataFrame:
    """Adds ``_key`` and ``_part``, neither ever NULL; rows without a time come first."""
    keyed = df.withColumn("_key", key_text(keys))
    return keyed.withColumn("_part", part_of(keyed, _place(order), part_rows))


def _inside(order: list[str]) -> Window:
    return Window.partitionBy("_key", "_part").orderBy(*order)


def _before() -> Window:
    return Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _whole(df: DataFrame) -> Column:
    """True of every row.  Readers of ``df`` that filter by it keep all columns, so that they share its scan and shuffle."""
    plain = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) >= F.lit(-(2**63))


def _ends(rows: DataFrame, order: list[str], end: Column) -> DataFrame:
    """_key, _part and ``_end`` of the last row of each part; found by looking one row ahead, not by an aggregate."""
    last = F.lead(F.lit(True)).over(_inside(order)).isNull()
    return rows.withColumn("_last", last).where(F.col("_last") & _whole(rows)).select("_key", "_part", end.alias("_end"))


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, part_rows: int | None = None
) -> DataFrame:
    """``name``: the last non-NULL ``value`` of the key up to and including the row."""
    local = F.last("_value", ignorenulls=True).over(_inside(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = _parted(df.withColumn("_value", value), keys, order, part_rows).withColumn("_local", local)
    ends = _ends(rows, order, F.col("_local"))
    carried = ends.select("_key", "_part", F.last("_end", ignorenulls=True).over(_before()).alias("_carry"))
    return (
        rows.where(_whole(rows)).join(carried, ["_key", "_part"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_value", "_local", "_carry", "_part", "_key")
    )


def running_count(
    df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str, part_rows: int | None = None
) -> DataFrame:
    """``name``: how many rows of the key up to and including the row have ``flag``."""
    inside = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _parted(df.withColumn("_flag", flag), keys, order, part_rows)
    rows = rows.withColumn("_local", F.count_if("_flag").over(inside))
    ends = _ends(rows, order, F.col("_local"))
    carried = ends.select("_key", "_part", F.coalesce(F.sum("_end").over(_before()), F.lit(0)).alias("_carry"))
    return (
        rows.where(_whole(rows)).join(carried, ["_key", "_part"])
        .withColumn(name, F.col("_local") + F.col("_carry"))
        .drop("_flag", "_local", "_carry", "_part", "_key")
    )


def _local_trailing(window: Window, n: int) -> Column:
    # Looking back n - 1 times costs less than collecting a list per row.
    earlier = [F.lag("_value", back).over(window) for back in range(n - 1, 0, -1)]
    return F.array_compact(F.array(*earlier, F.col("_value")))


def _last_n(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), F.lit(n))


def _joined_before(end: Column, before: Window) -> Column:
    """The arrays of the rows in the frame, put together."""
    return F.flatten(F.collect_list(end).over(before))


def trailing(
    df: DataFrame, keys: list[str], order: list[str], value: Column, n: int, name: str, part_rows: int | None = None
) -> DataFrame:
    """``name``: array of the last ``n`` values of the key, oldest first, the row's own last.

    A NULL value is a value like others; ``n`` is at least 2.
    """
    # In a struct, a NULL value differs from a missing row, whatever part it is in.
    rows = _parted(df.withColumn("_value", F.struct(value.alias("v"))), keys, order, part_rows)
    rows = rows.withColumn("_local", _local_trailing(_inside(order), n))
    # Every part of a key in the summary has a row, so the n - 1 before one hold all that it can need.
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(-(n - 1), -1)
    carried = _ends(rows, order, F.col("_local")).select("_key", "_part", _joined_before(F.col("_end"), before).alias("_carry"))
    joined = F.concat("_carry", "_local")
    return (
        rows.where(_whole(rows)).join(carried, ["_key", "_part"])
        .withColumn(name, F.when(F.size("_local") == n, F.col("_local")).otherwise(_last_n(joined, n)).getField("v"))
        .drop("_value", "_local", "_carry", "_part", "_key")
    )


def merged_trailing(
    left: DataFrame, right: DataFrame, keys: list[str], more_keys: list[str], left_value: Column, right_value: Column, n: int,
    part_rows: int | None = None,
) -> DataFrame:
    """``left`` with ``_own``, the last ``n`` values of its own series, and ``_other``, the last ``n`` of ``right`` as of its time (NULL if none).

    Both sides have ``keys``, ``ts`` and ``seq``; a series of ``left`` has ``more_keys`` besides.
    A right row at the same time is before.  Both sides are cut by the same bounds and meet in
    one shuffle, where one pass in the order of time sees both; what is open at a part's end
    (the last values of each series and of the right side) is handed to the next part.
    """
    columns = left.columns
    sides = left.select("*", F.lit(1).alias("_side"), F.struct(left_value.cast("double").alias("v")).alias("_value"), key_text(more_keys).alias("_series"))
    others = right.select(*keys, "ts", "seq", F.lit(0).alias("_side"), F.struct(right_value.cast("double").alias("v")).alias("_value"), F.lit("").alias("_series"))
    order = ["ts", "_side", "seq"]
    rows = _parted(sides.unionByName(others, allowMissingColumns=True), keys, order, part_rows).repartition("_key", "_part")
    by_series = Window.partitionBy("_key", "_part", "_side", "_series").orderBy("ts", "seq")
    rows = rows.withColumn("_local", _local_trailing(by_series, n)).withColumn("_last", F.lead(F.lit(True)).over(by_series).isNull())
    seen = F.last(F.when(F.col("_side") == 0, F.col("_local")), ignorenulls=True)
    rows = rows.withColumn("_seen", seen.over(_inside(order).rowsBetween(Window.unboundedPreceding, 0)))

    ends = rows.where(F.col("_last") & _whole(rows)).select("_key", "_part", "_side", "_series", "_local")
    earlier = Window.partitionBy("_key", "_side", "_series").orderBy("_part").rowsBetween(-(n - 1), -1)
    ends = ends.withColumn("_carry", _joined_before(F.col("_local"), earlier))
    # What the right side leaves open behind a part is carried over parts that have none of it.
    behind = F.when(F.col("_side") == 0, _last_n(F.concat("_carry", "_local"), n))
    entry = F.when(F.col("_side") == 1, F.struct("_series", "_carry"))
    summary = ends.groupBy("_key", "_part").agg(F.max(behind).alias("_behind"), F.map_from_entries(F.collect_list(entry)).alias("_carries"))
    carried = summary.select("_key", "_part", "_carries", F.last("_behind", ignorenulls=True).over(_before()).alias("_open"))

    none = F.array().cast("array<struct<v:double>>")
    own = F.when(F.size("_local") == n, F.col("_local")).otherwise(_last_n(F.concat(F.col("_carries")[F.col("_series")], F.col("_local")), n))
    before = F.concat(F.coalesce("_open", none), F.coalesce("_seen", none))
    other = F.when(F.size(before) > 0, _last_n(before, n))
    found = rows.where((F.col("_side") == 1) & _whole(rows)).join(carried, ["_key", "_part"])
    return found.select(*[F.col(f"`{c}`") for c in columns], own.getField("v").alias("_own"), other.getField("v").alias("_other"))


def mean(values: Column, start: int | None = None) -> Column:
    """Mean of an array, or of its last ``-start`` elements."""
    part = values if start is None else F.slice(values, F.greatest(F.size(values) + start + 1, F.lit(1)), -start)
    return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / F.size(part)


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], right_value: Column, name: str, part_rows: int | None = None,
) -> DataFrame:
    """Give each left row the last ``right_value`` of its key at or before its ``ts``."""
    sides = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, "ts", "seq", F.lit(0).alias("_side"), right_value.alias(name)), allowMissingColumns=True
    )
    order = ["ts", "_side", "seq"]
    matched = carry_forward(sides, keys, order, F.when(F.col("_side") == 0, F.col(name)), "_match", part_rows)
    return matched.where(F.col("_side") == 1).drop("_side", name).withColumnRenamed("_match", name)


def resource_trends(samples: DataFrame, keys: list[str], history: int = 10, part_rows: int | None = None) -> DataFrame:
    """Mean of the last three samples against the mean of the last ten, per sample.

    Input: keys, ``ts``, ``seq``, ``cpu_percent``, ``memory_percent``.  The first
    two samples of a key have no trend.
    """
    rows = trailing(samples, keys, ["ts", "seq"], F.struct("cpu_percent", "memory_percent"), history, "_history", part_rows)
    cpu, memory = F.col("_history.cpu_percent"), F.col("_history.memory_percent")
    enough = F.size("_history") >= 3
    rows = rows.withColumn("cpu_trend", F.when(enough, mean(cpu, -3) - mean(cpu)))
    rows = rows.withColumn("memory_trend", F.when(enough, mean(memory, -3) - mean(memory)))

    def direction(trend: str, limit: float) -> Column:
        c = F.col(trend)
        return F.when(F.abs(c) > limit, F.when(c > 0, "increasing").otherwise("decreasing"))

    return rows.drop("_history").select(
        "*",
        direction("cpu_trend", 10.0).alias("cpu_direction"),
        direction("memory_trend", 5.0).alias("memory_direction"),
        F.coalesce(F.col("cpu_trend") > 20.0, F.lit(False)).alias("cpu_warning"),
        F.coalesce(F.col("memory_trend") > 10.0, F.lit(False)).alias("memory_warning"),
    )


def throughput_cpu_correlation(
    resources: DataFrame, sink_samples: DataFrame, keys: list[str], part_rows: int | None = None
) -> DataFrame:
    """Per resource sample: sink throughput and CPU both above their mean of three, or at odds.

    ``sink_samples``: keys, ``ts``, ``seq``, ``ops_per_sec``.  With an unknown sample
    among the three there is neither.
    """
    resources = resources.select(*keys, "ts", "seq", "cpu_percent")
    rows = merged_trailing(resources, sink_samples, keys, [], F.col("cpu_percent"), F.col("ops_per_sec"), 3, part_rows)
    rows = rows.withColumnsRenamed({"_own": "_cpu", "_other": "_ops"})
    last = lambda a: F.element_at(a, -1)
    enough = F.coalesce((F.size("_cpu") == 3) & (F.size("_ops") == 3), F.lit(False))
    ops_up, cpu_up = last("_ops") > mean(F.col("_ops")), last("_cpu") > mean(F.col("_cpu"))
    known = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        *keys,
        "ts",
        F.when(enough, last("_ops")).alias("ops_per_sec"),
        "cpu_percent",
        known(enough & ops_up & cpu_up).alias("correlated"),
        known(enough & ~ops_up & cpu_up & (F.col("cpu_percent") > 70)).alias("anomaly"),
    )


def memory_degradation(
    worker_samples: DataFrame, resources: DataFrame, host_keys: list[str], worker_keys: list[str],
    part_rows: int | None = None,
) -> DataFrame:
    """Per worker sample: rate well below its mean of three while memory is well above its own.

    ``worker_samples``: host and worker keys, ``ts``, ``seq``, ``rate``.
    """
    every_worker = [*host_keys, *worker_keys]
    worker_samples = worker_samples.select(*every_worker, "ts", "seq", "rate")
    rows = merged_trailing(worker_samples, resources, host_keys, worker_keys, F.col("rate"), F.col("memory_percent"), 3, part_rows)
    rows = rows.withColumnsRenamed({"_own": "_rates", "_other": "_memory"})
    enough = F.coalesce((F.size("_rates") == 3) & (F.size("_memory") == 3), F.lit(False))
    slower = F.col("rate") < mean(F.col("_rates")) * 0.7
    fuller = F.element_at("_memory", -1) > mean(F.col("_memory")) * 1.2
    return rows.select(
        *every_worker,
        "ts",
        "rate",
        F.when(enough, F.element_at("_memory", -1)).alias("memory_percent"),
        F.coalesce(enough & slower & fuller, F.lit(False)).alias("degraded"),
    )


def high_throughput_mode(
    samples: DataFrame, keys: list[str], on_pct: float = 80.0, off_pct: float = 50.0, part_rows: int | None = None
) -> DataFrame:
    """Mode of a queue per sample: on above ``on_pct``, off below ``off_pct``, else as before."""
    fill = fill_pct(F.col("size"), F.col("capacity"))
    signal = F.when(fill > on_pct, True).when(fill < off_pct, False)
    rows = carry_forward(samples, keys, ["ts", "seq"], signal, "high_throughput", part_rows)
    return rows.withColumn("high_throughput", F.coalesce("high_throughput", F.lit(False)))


def stalled_workers(activity: DataFrame, keys: list[str], as_of_time: Column, limit_seconds: float = 60.0) -> DataFrame:
    """Seconds since the last activity per worker, and whether that is too long."""
    idle = (micros(as_of_time) - micros("last_ts")) / F.lit(1e6)
    return (
        activity.groupBy(*keys)
        .agg(F.max("ts").alias("last_ts"))
        .withColumn("idle_seconds", idle)
        .withColumn("stalled", F.col("idle_seconds") > limit_seconds)
    )


def outages(polls: DataFrame, keys: list[str], part_rows: int | None = None) -> DataFrame:
    """Runs of polls without a connection: start, last skipped poll, restore time, skipped polls.

    Input: keys, ``ts``, ``seq``, ``connected``.  A run is named by the number of
    connected polls before it; the connected poll that ends it is the next one.
    """
    up = F.col("connected")
    counted = running_count(polls, keys, ["ts", "seq"], up, "_ups", part_rows)
    named = counted.withColumn("_run", F.when(up, F.col("_ups") - 1).otherwise(F.col("_ups")))
    return (
        named.groupBy(*keys, "_run")
        .agg(
            F.min(F.when(~up, F.col("ts"))).alias("outage_start"),
            F.max(F.when(~up, F.col("ts"))).alias("last_skipped"),
            F.min(F.when(up, F.col("ts"))).alias("restored_at"),
            F.count_if(~up).alias("skipped_polls"),
        )
        .where(F.col("skipped_polls") > 0)
        .drop("_run")
    )


def retained_history(
    rows: DataFrame, as_of_time: Column, host_keys: list[str] | None = None, seconds: int = 3600, entries: int = 1000
) -> DataFrame:
    """Rows not older than ``seconds``, of those the newest ``entries`` per host.

    Input has one row per worker: ``ts`` and a unique ``seq``.
    """
    age = micros(as_of_time) - micros("ts")
    young = rows.where(age <= seconds * 1_000_000)
    return ranking.newest(young, ["ts", "seq"], entries, host_keys or [])


def queue_fill_severity(fill: Column, warning: float = 70.0, critical: float = 90.0) -> Column:
    return F.when(fill > critical, "error").when(fill > warning, "warning").otherwise("info")


def slow_alert_severity(elapsed: Column) -> Column:
    """Band of a processing time in seconds; NULL up to one second."""
    return F.when(elapsed > 10, "critical").when(elapsed > 5, "very_slow").when(elapsed > 1, "slow")


def immediate_alerts(events: DataFrame, very_slow: float = 5.0) -> DataFrame:
    """Telemetry events that call for a warning at once; batch and stream.

    Input: ``event_type``, ``ts`` and the measured fields, NULL where a kind of
    event lacks them.
    """
    worker = (F.col("extremely_slow_alerts") > 0) & (F.col("last_processing_time") > very_slow)
    sink = F.col("total_time") > very_slow
    service = (F.col("error_rate") > 10.0) | (F.col("avg_response_time") > 2.0)
    kind = F.col("event_type")
    hit = (
        F.when(kind == "worker_performance", worker)
        .when(kind == "kafka_performance", sink)
        .when(kind == "service_performance", service)
    )
    return events.where(hit)


ROUTED_EVENTS = ("worker_performance", "worker_last_processed", "kafka_performance")


def route(events: DataFrame) -> DataFrame:
    """``route``: the event type if a consumer exists for it, else ``unknown``."""
    kind = F.col("event_type")
    return events.withColumn("route", F.when(kind.isin(*ROUTED_EVENTS), kind).otherwise("unknown"))
