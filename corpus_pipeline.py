"""From raw documents to encoded training text, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
kept.  ``run`` writes each stage's rows as Parquet below the shared checkpoint folder and
reads them back as the next stage's input, so that a lost executor costs one stage's tasks
and no lineage grows.  A stage's rows are removed when the next stage has written its own; those
of the last written stage stay, for the result reads them.  All stages but the last return the columns of ``documents``.

Nulls: a null or letterless text has no language and goes in the first stage; a null id is
an id like others that loses against all; null languages and sources stay as they are.
Rows that repeat an id and a text are one document to the dedup stages.  An empty table
passes all stages.  Columns besides those of ``documents`` are carried along.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import exact, language, mixing, pieces, simhash
from alertloom.llm.queries import PIECES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; ``und`` and doubtful ones go."""
    return language.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.resampled(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and digests of them and of what they decode to."""
    found = pieces.encoded(docs.select("doc_id", "text"), PIECES)
    return found.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_text),
]

# SQL can express neither the language model nor the tokenizer.  Tests hold language posteriors, exact groups, near-duplicate
# components, the drawn sizes and the ids against brute force or the library, operator by operator.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{folder}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}-{name}")
        docs = spark.read.parquet(f"{at}/{number}-{name}")
        if before:
            _remove(spark, before)
        before = f"{at}/{number}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
