"""Interval tables that late rows correct.

A micro-batch adds mergeable partial sums of its own rows under its batch id; reading
merges them.  So a row that is hours late still counts in its interval, no watermark closes
one, and no state is kept.  A batch that is run again after a crash replaces its own
partials.  Partials of old batches are compacted into one table.  With a retention, rows
that are older than the newest time of earlier batches by more than that go, counted, to a
side table, and so do rows without a time.

Folders below the table's: ``partials/batch=N``, ``late/batch=N``, ``seen/batch=N`` (newest
time), ``compacted/upto=N`` (all batches up to N).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators import telemetry


def _folders(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the finished sub-folders ``prefix=N``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith(f"{prefix}=")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _read(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*folders) if folders else None


def adder(
    folder: str, partials: Callable[[DataFrame], DataFrame], keys: list[str], retention: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the partials of a batch; ``ts`` has the event time."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp")).persist()
        try:
            # Only earlier batches decide, so that a batch gives the same when it is run again.
            earlier = [f"{folder}/seen/batch={n}" for n in _folders(spark, f"{folder}/seen", "batch") if n < number]
            newest = _read(spark, earlier).agg(F.max("newest")).head()[0] if earlier and retention else None
            late = F.col("ts").isNull()
            if newest is not None:
                late = late | (F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {retention}"))
            partials(rows.where(~late)).write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")
            counted = rows.where(late).groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("rows"))
            counted.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
            rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        finally:
            rows.unpersist()

    return add


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All partials: the last compacted table and the batches after it."""
    upto = max(_folders(spark, f"{folder}/compacted", "upto"), default=-1)
    later = [f"{folder}/partials/batch={n}" for n in _folders(spark, f"{folder}/partials", "batch") if n > upto]
    return _read(spark, [*([f"{folder}/compacted/upto={upto}"] if upto >= 0 else []), *later])


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Keys, ``ts`` and ``rows`` of what came after the retention or without a time."""
    return _read(spark, [f"{folder}/late/batch={n}" for n in _folders(spark, f"{folder}/late", "batch")])


def compact(spark: SparkSession, folder: str, merged: Callable[[DataFrame], DataFrame], keep: int = 10) -> int:
    """Merges all batches but the ``keep`` newest into one table and removes what it replaces; the last batch in it, or -1.

    Readers see the batches until the table is finished, and the table from then on.  Batches
    go in the next compaction after the one that took them in, so that a reader that has
    listed them can still finish.
    """
    tables = _folders(spark, f"{folder}/compacted", "upto")
    before = max(tables, default=-1)
    batches = _folders(spark, f"{folder}/partials", "batch")
    taken = [n for n in batches if n > before][: -keep or None]
    if not taken:
        return before
    sources = [f"{folder}/partials/batch={n}" for n in taken] + ([f"{folder}/compacted/upto={before}"] if before >= 0 else [])
    merged(_read(spark, sources)).write.mode("overwrite").parquet(f"{folder}/compacted/upto={taken[-1]}")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old = [f"partials/batch={n}" for n in batches if n <= before] + [f"compacted/upto={n}" for n in tables if n < before]
    for name in old:
        path = jvm.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)
    return taken[-1]


def store(
    rows: DataFrame, folder: str, progress: str, partials: Callable[[DataFrame], DataFrame], keys: list[str],
    *, retention: str | None = None, once: bool = False,
) -> StreamingQuery:
    """Adds every micro-batch of ``rows`` to the table below ``folder``."""
    writer = rows.writeStream.option("checkpointLocation", progress).foreachBatch(adder(folder, partials, keys, retention))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def sink_intervals(spark: SparkSession, folder: str, keys: list[str], interval_seconds: float = telemetry.INTERVAL_SECONDS) -> DataFrame:
    """The interval table of ``telemetry.sink_partials`` as it stands."""
    return telemetry.finished_partials(telemetry.merged_partials(stored(spark, folder), keys), interval_seconds)
