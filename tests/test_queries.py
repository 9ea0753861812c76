"""Every registered query against its expected result in DuckDB."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from querybook import inputs
from querybook.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_is_described():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, queries()[name], oracle_sql()[name]) is None


def test_large_tables_are_read_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(10_000).withColumn("event_id", F.col("id"))
    for name, files in (("events", 1), ("lineitem", 16)):
        rows.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    stored = spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions()
    for most, parts in ((500, [20, 20]), (1_250, [8, stored])):
        monkeypatch.setattr(inputs, "TASK_ROWS", most, raising=False)
        read = [inputs.table(spark, str(tmp_path), name) for name in ("events", "lineitem")]
        assert [sorted(r.event_id for r in t.collect()) for t in read] == [list(range(10_000))] * 2
        assert [t.rdd.getNumPartitions() for t in read] == parts
