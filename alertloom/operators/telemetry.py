"""Interval and cumulative statistics of workers, sinks and queues.

Durations are integer microseconds (``elapsed_us``), so sums are exact however
the rows are partitioned.  ``keys`` name the sender (host, service, worker ...);
an empty list treats the table as one process.  The tumbling aggregates combine
map-side and also run on streams with a watermark; running totals read the
stored interval tables, whose size depends on the time span, not on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.times import micros, moment
from alertloom.operators import ranking
from alertloom.operators.keys import join_null_safe

SECOND = 1_000_000
INTERVAL = "600 seconds"
INTERVAL_SECONDS = 600.0
STAGES = ("prep", "encode", "send", "connect")


def seconds(micros: Column) -> Column:
    return micros / F.lit(float(SECOND))


def _mean_seconds(micros: Column) -> Column:
    return F.sum(micros) / F.count(micros) / F.lit(float(SECOND))


def worker_performance(
    processed: DataFrame, keys: list[str], elapsed_seconds: float | None = None, slow: float = 2.0,
    very_slow: float = 5.0, interval: str | None = None,
) -> DataFrame:
    """Per worker: counts, mean, extremes, slow bands, last time and id, rate.

    Input: keys, ``ts``, ``seq``, ``alert_id``, ``elapsed_us``.  The rate is per
    second of ``elapsed_seconds``, or of the time between the first and last row.
    With ``interval`` there is one row per worker and tumbling interval.
    """
    us, at = F.col("elapsed_us"), F.struct("ts", "seq")
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(float(SECOND))
    period = F.lit(float(elapsed_seconds)) if elapsed_seconds else span
    n = F.count(F.lit(1))
    spans = [F.window("ts", interval).alias("span")] if interval else []
    rows = processed.groupBy(*keys, *spans).agg(
        n.alias("alerts_processed"),
        F.sum(us).alias("total_us"),
        _mean_seconds(us).alias("avg_processing"),
        seconds(F.min(us)).alias("min_time"),
        seconds(F.max(us)).alias("max_time"),
        F.count_if((us > slow * SECOND) & (us <= very_slow * SECOND)).alias("slow_alerts"),
        F.count_if(us > very_slow * SECOND).alias("extremely_slow_alerts"),
        seconds(F.max_by(us, at)).alias("last_processing_time"),
        F.max_by("alert_id", at).alias("last_alert_id"),
        F.coalesce(F.when(period > 0, n / period), F.lit(0.0)).alias("rate"),
        F.max("ts").alias("last_ts"),
    )
    return rows.withColumn("span", F.col("span.start")).withColumnRenamed("span", "interval_start") if interval else rows


def recent_average(processed: DataFrame, keys: list[str], last: int = 100) -> DataFrame:
    """Mean duration of the last ``last`` rows per worker."""
    recent = ranking.newest(processed.select(*keys, "ts", "seq", "elapsed_us"), ["ts", "seq"], last, keys)
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), _mean_seconds(F.col("elapsed_us")).alias("recent_avg")
    )


def sink_partials(operations: DataFrame, keys: list[str], interval: str = INTERVAL, slow: float = 1.0) -> DataFrame:
    """Mergeable sums of ``sink_intervals``: per key and interval what several parts of its rows can be put together from.

    ``first_longest`` orders the maxima: longest, then earliest, then smallest ``seq``.
    """
    us = F.col("elapsed_us")
    is_slow = us > slow * SECOND
    first_longest = F.struct(us.alias("us"), (-micros("ts")).alias("before"), (-F.col("seq")).alias("sooner"))
    rows = operations.groupBy(*keys, F.window("ts", interval).alias("span")).agg(
        F.count(F.lit(1)).alias("operations"),
        F.count_if(is_slow).alias("slow_operations"),
        F.max(us).alias("max_us"),
        F.max_by("stages", first_longest).alias("max_stages"),
        F.max(F.when(is_slow, us)).alias("slow_max_us"),
        F.max(first_longest).alias("first_longest"),
    )
    return rows.select(*keys, F.col("span.start").alias("interval_start"), *rows.columns[len(keys) + 1 :])


def merged_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of the same key and interval put together; partials again."""
    return partials.groupBy(*keys, "interval_start").agg(
        F.sum("operations").alias("operations"),
        F.sum("slow_operations").alias("slow_operations"),
        F.max("max_us").alias("max_us"),
        F.max_by("max_stages", "first_longest").alias("max_stages"),
        F.max("slow_max_us").alias("slow_max_us"),
        F.max("first_longest").alias("first_longest"),
    )


def finished_partials(partials: DataFrame, interval_seconds: float = INTERVAL_SECONDS) -> DataFrame:
    """The interval table of merged partials."""
    return partials.drop("first_longest").select(
        "*",
        (F.col("operations") / F.lit(interval_seconds)).alias("ops_per_sec"),
        (F.col("slow_operations") / F.col("operations") * 100).alias("slow_pct"),
    )


def sink_intervals(
    operations: DataFrame, keys: list[str], interval: str = INTERVAL, interval_seconds: float = INTERVAL_SECONDS,
    slow: float = 1.0,
) -> DataFrame:
    """Per interval: operations, slow ones, the maximum with its stage times, rates.

    Input: keys, ``ts``, ``seq``, ``elapsed_us``, ``stages`` MAP<STRING, BIGINT>.
    Among equal maxima the first one's stages are kept.  ``slow_max_us`` is the
    maximum over slow operations, which the cumulative form needs.
    """
    return finished_partials(sink_partials(operations, keys, interval, slow), interval_seconds)


def _up_to_now(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)


def sink_cumulative(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals over the interval table; only slow operations set the all-time maximum."""
    run = _up_to_now(keys)
    return intervals.select(
        *keys,
        "interval_start",
        F.sum("operations").over(run).alias("total_operations"),
        F.sum("slow_operations").over(run).alias("total_slow"),
        F.coalesce(F.max("slow_max_us").over(run), F.lit(0)).alias("all_time_max_us"),
    ).withColumn("slow_pct", F.col("total_slow") / F.col("total_operations") * 100)


def _by_rank(a: Column, b: Column) -> Column:
    return F.when(a["_rank"] < b["_rank"], -1).otherwise(1)


def slow_sink_intervals(
    operations: DataFrame, keys: list[str], interval: str = INTERVAL, slow: float = 1.0, examples: int = 5
) -> DataFrame:
    """Interval statistics over slow operations, with the stage times of some of them.

    The examples start at the first operation that reached the maximum and go on
    with the slow operations after it, ``examples`` in all.
    """
    us = F.col("elapsed_us")
    is_slow = us > slow * SECOND
    rows = operations.withColumn("interval_start", F.window("ts", interval)["start"])
    group = [*keys, "interval_start"]
    at = F.struct("ts", "seq")
    first_longest = F.struct(us, -micros("ts"), -F.col("seq"))
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.count_if(is_slow).alias("slow_operations"),
        F.max_by(us, F.when(is_slow, at)).alias("last_slow_us"),
        F.max(F.when(is_slow, us)).alias("max_us"),
        F.max_by(at, F.when(is_slow, first_longest)).alias("_peak"),
    )
    order = Window.partitionBy(*group).orderBy("ts", "seq")
    picked = (
        join_null_safe(rows.where(is_slow), stats.select(*group, "_peak"), group)
        .where(F.struct("ts", "seq") >= F.col("_peak"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= examples)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "stages")), _by_rank).alias("_examples"))
        .select(*group, F.col("_examples.stages").alias("recent_stages"))
    )
    no_example = F.array().cast("array<map<string,bigint>>")
    return (
        join_null_safe(stats.drop("_peak"), picked, group, "left")
        .withColumn("last_slow_us", F.coalesce("last_slow_us", F.lit(0)))
        .withColumn("max_us", F.coalesce("max_us", F.lit(0)))
        .withColumn("recent_stages", F.coalesce("recent_stages", no_example))
    )


def stage_breakdown(intervals: DataFrame, keep: list[str]) -> DataFrame:
    """Share of each stage in the slowest operation, and the stage above half of it.

    Intervals without a slow operation give no row.  All stages of the map count
    towards the total; the first of the named stages wins a tie.
    """
    stages = F.col("max_stages")
    total = F.aggregate(F.map_values(stages), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    rows = intervals.where((F.col("slow_operations") > 0) & (F.size("max_stages") > 0)).select(
        *keep, "max_stages", total.alias("total_us")
    )
    share = lambda name: F.coalesce(
        F.when(F.col("total_us") > 0, F.coalesce(stages[name], F.lit(0)) / F.col("total_us") * 100), F.lit(0.0)
    )
    shares = rows.select(*keep, "total_us", *[share(s).alias(f"{s}_pct") for s in STAGES])
    top = F.greatest(*[F.col(f"{s}_pct") for s in STAGES])
    named = F.coalesce(*[F.when((F.col(f"{s}_pct") == top) & (top > 50), F.lit(s)) for s in STAGES])
    return shares.withColumn("bottleneck", named)


def queue_intervals(
    samples: DataFrame, keys: list[str], full: Column, interval: str = INTERVAL, interval_seconds: float = INTERVAL_SECONDS
) -> DataFrame:
    """Per interval: processed, largest and last size, samples that were ``full``, throughput.

    Input: keys, ``ts``, ``seq``, ``size``, ``capacity``, ``processed``.
    """
    rows = samples.groupBy(*keys, F.window("ts", interval).alias("span")).agg(
        F.sum("processed").alias("total_processed"),
        F.max("size").alias("max_queue_size"),
        F.count_if(full).alias("queue_full_count"),
        F.max_by("size", moment("ts", "seq")).alias("last_queue_size"),
        F.max("capacity").alias("config_max_queue_size"),
    )
    return rows.select(
        *keys,
        F.col("span.start").alias("interval_start"),
        "total_processed",
        "max_queue_size",
        "config_max_queue_size",
        "queue_full_count",
        "last_queue_size",
        (F.col("total_processed") / F.lit(interval_seconds)).alias("throughput"),
    )


def nearly_full(limit_pct: float = 80.0) -> Column:
    """An alert queue counts as full above ``limit_pct`` of its capacity."""
    return F.coalesce(fill_pct(F.col("size"), F.col("capacity")) > limit_pct, F.lit(False))


def at_capacity() -> Column:
    """An event queue counts as full at its capacity."""
    return F.col("size") >= F.col("capacity")


def fill_pct(size: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, size / capacity * 100).otherwise(0.0)


def queue_cumulative(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals of the queue interval table."""
    run = _up_to_now(keys)
    return intervals.select(
        *keys,
        "interval_start",
        F.sum("total_processed").over(run).alias("total_processed"),
        F.max("max_queue_size").over(run).alias("all_time_max_size"),
        F.sum("queue_full_count").over(run).alias("total_full_count"),
    )


def last_values(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last row per key; later rows replace earlier ones."""
    last = F.max_by(F.struct("ts", "seq", *values), F.struct("ts", "seq"))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.ts", *[f"_last.{v}" for v in values])


def capacity_utilization(queues: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of last size over observed maximum size, each at most 1; 0 without a used queue."""
    ratio = F.when(
        F.col("max_queue_size") > 0, F.least(F.lit(1.0), F.col("last_queue_size") / F.col("max_queue_size"))
    )
    return queues.groupBy(*keys).agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("capacity_utilization"))


def service_metrics(operations: DataFrame, keys: list[str], last: int = 100, slow: float = 1.0) -> DataFrame:
    """Operation totals per service; mean and slow count over the last ``last`` operations.

    Input: keys, ``ts``, ``seq``, ``elapsed_us``, ``success``.
    """
    us = F.col("elapsed_us")
    totals = operations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.count_if("success").alias("successful_operations"),
        F.count_if(~F.col("success")).alias("failed_operations"),
        seconds(F.max(us)).alias("max_response_time"),
    )
    recent = ranking.newest(operations.select(*keys, "ts", "seq", "elapsed_us"), ["ts", "seq"], last, keys)
    recent = recent.groupBy(*keys).agg(
        _mean_seconds(us).alias("avg_response_time"),
        F.count_if(us > slow * SECOND).alias("slow_operations_count"),
    )
    if keys:
        return join_null_safe(totals, recent, keys)
    measured = recent.select(F.struct("avg_response_time", "slow_operations_count")).scalar()
    return totals.withColumn("_recent", measured).select(*totals.columns, "_recent.*")
