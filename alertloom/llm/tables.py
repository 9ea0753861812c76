"""Helpers shared by the operators: checkpoints, Arrow slices, names and row selection."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text handed to numpy or to a tokenizer at once, in bytes.
SLICE_BYTES = 2_000_000
# Longest key that a worker's cache keeps, in characters.
LONGEST_KEPT = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
    session that names none (a test on one machine) gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Recent(dict):
    """A cache of ``compute(key)`` that holds the last ``limit`` new keys and what was used of the ``limit`` before.

    Keys longer than ``longest`` are computed each time, so that the size is bounded in bytes too.
    """

    def __init__(self, compute: Callable, limit: int, longest: int = LONGEST_KEPT):
        super().__init__()
        self.longest = longest
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``text`` holds about ``limit`` bytes in each; a longer text comes alone."""
    for batch in batches:
        column = batch.column(text)
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def keep_rows(docs: DataFrame, key: dict[str, Column], kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept``; of rows that share a key, one.

    ``kept`` has the columns named in ``key``, unique together, and ``copies``: how
    many rows of ``docs`` have that key.  Rows are matched by a shuffle on the key
    (or a broadcast, where ``kept`` turns out small).  Only rows of keys that occur
    more than once are grouped, and only if there are any.
    """
    names = {k: fresh(docs, f"key_{k}") for k in key}
    copies = fresh(docs, "key_copies")
    keyed = docs.withColumns({names[k]: column for k, column in key.items()})
    wanted = kept.select(*[F.col(k).alias(names[k]) for k in key], F.col("copies").alias(copies))
    # Keys are texts or numbers without nulls, so that the join is a plain equality.
    joined = keyed.join(wanted, list(names.values()), "inner")
    rows = joined.where(F.col(copies) == 1)
    if wanted.where(F.col(copies) > 1).limit(1).count():
        rows = rows.unionByName(joined.where(F.col(copies) > 1).dropDuplicates(list(names.values())))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
