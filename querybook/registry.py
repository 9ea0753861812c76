"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertloom.session import configure
from querybook import alerts, alerts_expected, streams, telemetry, telemetry_expected

Query = Callable[[SparkSession, str], DataFrame]


def _configured(query: Query) -> Query:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def registered() -> dict[str, Query]:
    return {q.__name__: _configured(q) for q in [*alerts.QUERIES, *telemetry.QUERIES, *streams.QUERIES]}


def expected_sql() -> dict[str, str]:
    return alerts_expected.EXPECTED | telemetry_expected.EXPECTED | {
        "alert_stream": alerts_expected.STREAM,
        "interval_stream": telemetry_expected.INTERVAL_STREAM,
        "rate_limit_stream": telemetry_expected.EXPECTED["rate_limit"],
    }
