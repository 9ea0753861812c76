"""Alert files as line tables: batch scan and stream over closed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def alert_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line of the alert files: ``line``, ``source_file``, ``arrived_at``.

    Lines end at LF, CRLF or a lone CR.  Files are split by size, so one huge
    file is read by many tasks.
    """
    return _with_origin(spark.read.text(path))


def alert_line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The same rows as a stream over a folder that receives closed segments."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return _with_origin(reader.text(folder))


def _with_origin(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )
