"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the token counts of frequent pre-tokens, gathered from a
bounded sample of rows and broadcast: keys in one string, counts in one byte array.
Tier two is each worker's own cache; a pre-token that neither has is encoded by the
tokenizer's library and kept.  Pre-tokens never shuffle;
the table only saves work, results do not depend on what is in it.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import pieces
from alertloom.llm.tables import Recent, slices

# Rows whose pre-tokens are counted for the table, about.
SAMPLE_ROWS = 10_000
# Entries of the broadcast table, and candidates that one task of the sample names.
TABLE_ENTRIES = 32_768
SAMPLE_TASKS = 16
# Longest pre-token in the table, in characters; with TABLE_ENTRIES it bounds the broadcast.
LONGEST_KEY = 64
# Pre-tokens that a worker keeps: this many of late, and as many from before.
CACHE_ENTRIES = 400_000
OVER = 4096


class SentencePieceCounter:
    """Pre-tokens of a SentencePiece text and their token counts."""

    def __init__(self, path: str):
        self.words = pieces.vocabulary(path)

    def split(self, text: str) -> list[str]:
        return self.words.segments(text)

    def count(self, token: str) -> int:
        """Tokens that the library makes of a pre-token."""
        return len(self.words.library.encode(self.words.apart + token)) - self.words.apart_size


@functools.cache
def counter(path: str) -> SentencePieceCounter:
    """One per worker and path."""
    return SentencePieceCounter(path)


class Table:
    """The frequent pre-tokens: one string, where each ends in it, and their counts."""

    def __init__(self, counts: dict[str, int]):
        self.keys = "".join(counts)
        self.ends = np.cumsum(np.fromiter(map(len, counts), np.int32, len(counts)), dtype=np.int32)
        self.counts = np.fromiter(counts.values(), np.uint8, len(counts))

    def entries(self) -> dict[str, int]:
        ends = [0, *self.ends.tolist()]
        return {self.keys[a:b]: n for (a, b), n in zip(itertools.pairwise(ends), self.counts.tolist())}


def frequent(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> Table:
    """The table of the pre-tokens that are most frequent in about ``rows`` rows, chosen by a hash of the text."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = texts.where(draw < int(share * (1 << 30))).repartition(SAMPLE_TASKS)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = counter(path).split, Counter()
        for part in slices(parts, "text"):
            for text in part.column("text").to_pylist():
                seen.update(s for s in split(text) if len(s) <= LONGEST_KEY)
            if len(seen) > 16 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        best = seen.most_common(entries // 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["token", "n"]
        )

    # At most SAMPLE_TASKS * TABLE_ENTRIES / 4 short rows.
    seen: Counter[str] = Counter()
    for r in sample.mapInArrow(count, "token string, n bigint").collect():
        seen[r["token"]] += r["n"]
    chosen = [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    counts = {k: counter(path).count(k) for k in chosen}
    return Table({k: n for k, n in counts.items() if n < 256})


class _FirstTier(dict):
    """The broadcast table; what it lacks comes from the worker's cache."""

    def __init__(self, table: Table, count: Callable[[str], int]):
        super().__init__(table.entries())
        self.second = Recent(count, CACHE_ENTRIES)

    def __missing__(self, token: str) -> int:
        return self.second[token]


class _Lookup:
    """Both tiers in one worker."""

    def __init__(self, path: str, table: Table):
        self.counter = counter(path)
        self.lengths = _FirstTier(table, self.counter.count)

    def __call__(self, texts: list[str]) -> list[int]:
        get, split = self.lengths.__getitem__, self.counter.split
        return [sum(map(get, split(t))) for t in texts]


_LOOKUPS: dict[tuple[str, int], _Lookup] = {}


def counted(docs: DataFrame, path: str, over: int = OVER, table: Table | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null and empty texts
    have no bytes and no tokens.  Repeated rows each give a row.  ``over_limit`` tells
    whether there are more than ``over`` tokens.
    """
    table = frequent(docs, path) if table is None else table
    shared = docs.sparkSession.sparkContext.broadcast(table)
    number = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, number) not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[path, number] = _Lookup(path, shared.value)
        lookup = _LOOKUPS[path, number]
        for part in slices(parts, "text"):
            tokens = lookup(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    schema = rows.select("doc_id", "n_bytes").schema.add("n_tokens", "long")
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > over)
