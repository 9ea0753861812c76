"""The alert job on Structured Streaming: closed segments in, checkpointed delivery out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.plans import alert_plan
from alertloom.plans.alert_plan import AlertJob
from alertloom.session import checkpoint_folder
from alertloom.sources.alert_files import alert_line_stream

Sink = Callable[[DataFrame, int], None]


def folder_sink(folder: str) -> Sink:
    """Write each batch to its own subfolder, so that a replayed batch replaces itself."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def kafka_sink(options: dict[str, str]) -> Sink:
    """Send values to the topic named in the options; needs the Kafka connector."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.format("kafka").options(**options).save()

    return write


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def deliver(job: AlertJob, staging: str, messages: Sink, replies: Sink, dead_letters: Sink) -> Sink:
    """Batch function: stage all records once, send messages, then reply.

    Acknowledgements and errors are published only after the messages are out.  If a step
    fails the batch is not committed and runs again: delivery is at least once,
    and exactly once for sinks that replace a batch.  What was staged is removed when
    all of it is out.
    """

    def run(lines: DataFrame, batch_id: int) -> None:
        place = f"{staging}/batch={batch_id}"
        alert_plan.records(lines, job, ["source_file"]).write.mode("overwrite").partitionBy("stream").parquet(place)
        schema = "source_file string, branch string, value string, reason string, raw binary, stream string"
        staged = lines.sparkSession.read.schema(schema).parquet(place)
        of = lambda *names: staged.where(F.col("stream").isin(*names))
        messages(of(alert_plan.MESSAGE).select("value"), batch_id)
        replies(of(alert_plan.ACK, alert_plan.ERROR).select("stream", "value"), batch_id)
        dead_letters(of(alert_plan.REJECTED, alert_plan.QUARANTINE), batch_id)
        _remove(lines.sparkSession, place)

    return run


def start(
    spark: SparkSession, folder: str, job: AlertJob, name: str, messages: Sink, replies: Sink, dead_letters: Sink,
    *, once: bool = False, every: str = "1 second", files_per_batch: int = 1000, base: str | None = None,
) -> StreamingQuery:
    """Start the job over a folder of closed segments.

    State lives below ``spark.checkpoint.dir``; ``base`` replaces it only where
    the session names none.
    """
    home = f"{checkpoint_folder(spark, base)}/{name}"
    lines = alert_line_stream(spark, folder, files_per_batch)
    writer = (
        lines.writeStream.queryName(name)
        .option("checkpointLocation", f"{home}/progress")
        .foreachBatch(deliver(job, f"{home}/staging", messages, replies, dead_letters))
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
