"""Newest rows with missing order values, on both sides of the map-side rank limit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alertloom.operators.ranking import newest
from alertloom.operators.requests import allowed_by_table, client_address


@pytest.mark.parametrize("n", [999, 1000, 1001, 1150, 1200, 5000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_missing_times_are_oldest(spark, n, keys):
    rows = spark.range(1200).select(
        (F.col("id") * 0).alias("k"), "id",
        F.when(F.col("id") % 10 > 0, F.timestamp_seconds(F.col("id") * 7)).alias("ts"),
    )
    found = {r["id"] for r in newest(rows, ["ts", "id"], n, keys).collect()}
    order = sorted(range(1200), key=lambda k: (k % 10 > 0, k), reverse=True)
    assert found == set(order[:n])


def test_unreadable_network_matches_no_one(spark):
    requests = spark.createDataFrame([("10.0.0.1",), ("192.0.2.9",)], "ip string")
    networks = spark.createDataFrame([("10.0.0.0/abc",), ("192.0.2.0/24",)], "network string")
    found = {r["ip"]: r["allowed"] for r in allowed_by_table(requests, networks, "ip").collect()}
    assert found == {"10.0.0.1": False, "192.0.2.9": True}


def test_all_white_space_is_trimmed(spark):
    row = spark.range(1).select(client_address(F.lit("\t10.0.0.1\t, x"), F.lit(""), F.lit("")).alias("ip")).first()
    assert row["ip"] == "10.0.0.1"
