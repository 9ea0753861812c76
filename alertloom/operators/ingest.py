"""From lines to parsed alerts: frame, size guard, decode, strict parse, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions import json_text
from alertloom.operators import ranking

REASON_OVERSIZE = "oversize"
REASON_TRUNCATED = "truncated"
REASON_BAD_ENCODING = "invalid_utf8"
REASON_BAD_JSON = "invalid_json"


def frame(lines: DataFrame, prefix: str = fixed.ALERT_PREFIX) -> DataFrame:
    """Keep lines that hold the prefix and cut what stands before it."""
    start = F.instr("line", F.lit(prefix))
    return lines.where(F.contains("line", F.lit(prefix))).withColumn(
        "line", F.substr(F.col("line"), start, F.lit(2147483647))
    )


def size_guard(framed: DataFrame, limit: int = fixed.MAX_LINE_BYTES) -> DataFrame:
    """Mark lines longer than ``limit`` bytes: boolean ``oversize``."""
    return framed.withColumn("oversize", F.octet_length("line") > limit)


def decode(framed: DataFrame) -> DataFrame:
    """``text``: the line as valid UTF-8; ``replaced``: bad bytes became U+FFFD."""
    return framed.withColumn("replaced", ~F.is_valid_utf8("line")).withColumn(
        "text", F.make_valid_utf8("line")
    )


def strict_parse(
    framed: DataFrame, prefix: str = fixed.ALERT_PREFIX, limit: int = fixed.MAX_LINE_BYTES
) -> DataFrame:
    """Parse every framed line once.

    Adds ``text``, ``replaced``, ``alert`` (VARIANT) and ``reason``, which is
    NULL exactly for the rows that became an alert.  No row is dropped.
    """
    checked = decode(size_guard(framed, limit))
    closed = F.instr(F.substr(F.col("line"), F.lit(len(prefix) + 1)), F.lit(fixed.ALERT_SUFFIX)) > 0
    kept = [c for c in checked.columns if c != "text"]
    stripped = F.when(~F.col("oversize") & closed, json_text.strip_right(F.col("text")))
    parsed = checked.select(*kept, closed.alias("closed"), stripped.alias("text")).select(
        *kept, "closed", "text", json_text.once(document=json_text.sealed(F.col("text")))
    )
    alert = json_text.strict_document(F.col("text"), F.col("document"))
    done = parsed.select(*kept, "closed", "text", json_text.once(alert=alert))
    reason = (
        F.when(F.col("oversize"), REASON_OVERSIZE)
        .when(~F.col("closed"), REASON_TRUNCATED)
        .when(F.col("alert").isNull() & F.col("replaced"), REASON_BAD_ENCODING)
        .when(F.col("alert").isNull(), REASON_BAD_JSON)
    )
    return done.withColumn("reason", reason).drop("oversize", "closed")


def parse_lines(lines: DataFrame, prefix: str = fixed.ALERT_PREFIX) -> DataFrame:
    """Frame and parse in one step."""
    return strict_parse(frame(lines, prefix), prefix)


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows that became an alert."""
    return parsed.where(F.col("reason").isNull()).drop("reason")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rows to store for later analysis.

    ``raw`` holds the bytes as read.  Rows that were saved by replacing bad
    bytes are alerts *and* appear here, with the repaired text and no reason.
    """
    keep = [c for c in parsed.columns if c not in ("line", "text", "alert", "replaced", "reason")]
    return parsed.where(F.col("reason").isNotNull() | F.col("replaced")).select(
        *keep,
        F.col("line").cast("binary").alias("raw"),
        F.when(F.col("reason").isNull(), F.col("text")).alias("replaced_text"),
        F.coalesce("reason", F.lit("replaced")).alias("reason"),
    )


def slow_alerts_to_quarantine(processed: DataFrame, seconds: Column, limit: float = 10.0) -> DataFrame:
    """Alerts whose processing took longer than ``limit`` seconds."""
    return processed.where(seconds > limit).withColumn("reason", F.lit("slow_processing"))


def retain_newest(
    stored: DataFrame, order: list[str], keep: int = fixed.FAILED_ALERTS_KEPT, keys: list[str] | None = None
) -> DataFrame:
    """The newest ``keep`` stored rows, per ``keys`` if given."""
    return ranking.newest(stored, order, keep, keys or [])


def keep_latest(
    arrivals: DataFrame, order: list[str], bound: int = fixed.QUEUE_BOUND, keys: list[str] | None = None
) -> DataFrame:
    """What a bounded queue still holds when it drops its oldest entries."""
    return ranking.newest(arrivals, order, bound, keys or [])


def discarded_counts(arrivals: DataFrame, bound: int = fixed.QUEUE_BOUND, keys: list[str] | None = None) -> DataFrame:
    """How many entries a bounded queue kept and dropped."""
    n = F.count(F.lit(1))
    return arrivals.groupBy(*(keys or [])).agg(
        F.least(n, F.lit(bound)).alias("kept"), F.greatest(n - bound, F.lit(0)).alias("discarded")
    )


def ingest_stats(
    parsed: DataFrame, time: str, interval: str = "600 seconds", seconds: int = 600, keys: list[str] | None = None
) -> DataFrame:
    """Per interval: alerts per second, error rate, and the counters behind them.

    Batch and stream; on a stream set a watermark on ``time`` first.
    """
    good = F.col("reason").isNull()
    counted = parsed.groupBy(*(keys or []), F.window(time, interval).alias("span")).agg(
        F.count_if(good).alias("total_alerts"),
        F.count_if(~good).alias("error_count"),
        F.count_if(good & F.col("replaced")).alias("replaced_count"),
    )
    rate = F.when(F.col("total_alerts") > 0, F.col("error_count") / F.col("total_alerts") * 100)
    return counted.select(
        *(keys or []),
        F.col("span.start").alias("interval_start"),
        (F.col("total_alerts") / F.lit(float(seconds))).alias("alerts_per_second"),
        F.coalesce(rate, F.lit(0.0)).alias("error_rate"),
        "total_alerts",
        "error_count",
        "replaced_count",
    )
