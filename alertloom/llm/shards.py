"""Sharding by a minimax contiguous partition.

Documents with equal texts are an atomic group; groups are ordered by the SHA-256 of
their text.  The smallest shard capacity is found by binary search: a capacity is
feasible if filling shards greedily in order needs no more than there are.  Then the
order is cut there.

The driver never holds all groups.  It holds ranges of the order (common prefixes of the
hash) with their sizes, and splits only ranges that a cut falls next to into finer ones,
until every cut, and every stop of the greedy check that proves the capacity smallest,
is beside single groups.  Groups larger than an even share cannot be evened out by any
order; there are fewer of them than shards, and each gets a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertloom.llm.tables import checkpointed

SHARDS = 24
# Bytes that each row counts for besides its text.
ROW_BYTES = 8
# Hex digits by which a range is refined; each refined range gives at most 16 ** DIGITS finer ones.
DIGITS = 3
# Rows per numbering task, about.
SLOT_ROWS = 50_000


@dataclass
class _Range:
    """Groups whose hash starts with ``prefix``, consecutive in the order."""

    prefix: str
    size: int
    groups: int


def _greedy(sums: list[int], capacity: int, start: int, most: int) -> list[int] | None:
    """Where shards end if each takes all that fits from position ``start``; None if more than ``most`` are needed."""
    ends, at, last = [], start, len(sums) - 1
    while at < last:
        if len(ends) == most:
            return None
        end = bisect_right(sums, sums[at] + capacity, lo=at) - 1
        if end == at:
            return None
        ends.append(end)
        at = end
    return ends


def _smallest_capacity(sums: list[int], shards: int) -> int:
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _greedy(sums, middle, 0, shards) is not None else (middle + 1, high)
    return low


def _even_cuts(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of ``shards`` shards, none above ``capacity``, each as near an even part of what is left as that allows."""
    ends, at, last = [], 0, len(sums) - 1
    for left in range(shards, 0, -1):
        if left == 1:
            ends.append(last)
            break
        even = sums[at] + (sums[-1] - sums[at]) / left
        end = bisect_right(sums, even, lo=at) - 1
        if end < last and even - sums[end] > sums[end + 1] - even:
            end += 1
        end = min(max(end, min(at + 1, last)), bisect_right(sums, sums[at] + capacity, lo=at) - 1)
        # What is left has to fit; taking all that fits leaves the least.
        while _greedy(sums, capacity, end, left - 1) is None:
            end += 1
        ends.append(end)
        at = end
    return ends


def _partition(groups: DataFrame, shards: int) -> list[str]:
    """Hash prefixes at which the shards after the first begin; ``groups`` has text_sha256 and size."""
    prefix = lambda n: F.substring("text_sha256", 1, n)

    def ranges(rows: DataFrame, digits: int) -> list[_Range]:
        found = rows.groupBy(prefix(digits).alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))
        return [_Range(r["p"], r["size"], r["groups"]) for r in found.collect()]

    held = sorted(ranges(groups, DIGITS), key=lambda r: r.prefix)
    while True:
        sums = [0, *accumulate(r.size for r in held)]
        capacity = _smallest_capacity(sums, shards)
        ends = _even_cuts(sums, capacity, shards)
        # The greedy run one below the capacity has to fail for single groups, not for whole ranges.
        stops, at = [], 0
        while at < len(held) and len(stops) <= shards:
            end = bisect_right(sums, sums[at] + capacity - 1, lo=at) - 1
            stops.append(end)
            if end == at:
                break
            at = end
        beside = {k for end in (*ends, *stops) for k in (end - 1, end) if 0 <= k < len(held)}
        coarse = sorted(k for k in beside if held[k].groups > 1)
        if not coarse:
            return [held[end].prefix if end < len(held) else "g" for end in ends[:-1]]
        by_digits: dict[int, list[str]] = {}
        for k in coarse:
            by_digits.setdefault(len(held[k].prefix), []).append(held[k].prefix)
        fine: list[_Range] = []
        for digits, prefixes in by_digits.items():
            # A few dozen prefixes: the cuts of one round.
            fine += ranges(groups.where(prefix(digits).isin(prefixes)), digits + DIGITS)
        held = sorted([r for k, r in enumerate(held) if k not in set(coarse)] + fine, key=lambda r: r.prefix)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null text counts
    as empty.  ``size`` is the bytes of the text plus 8.  The law is ``bytes``: sizes of
    shards are near equal; rows with equal texts share a shard.  ``slot`` numbers the rows
    of a shard from 0 without gaps, in no particular order.  ``grown_shard`` is null, for no
    law of growth holds.  An empty table gives an empty result; with fewer groups than
    shards some shards are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpointed(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("text_sha256"),
        )
    )
    groups = checkpointed(rows.groupBy("text_sha256").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")))
    total = groups.agg(F.sum("size"), F.sum("copies")).first()
    # Groups above an even share; as they get shards of their own, the share of the rest falls.
    largest = groups.orderBy(F.desc("size"), "text_sha256").limit(shards).collect()
    alone: list[str] = []
    left = total[0] or 0
    while largest and len(alone) < min(shards - 1, len(largest)) and largest[len(alone)]["size"] * (shards - len(alone)) > left:
        left -= largest[len(alone)]["size"]
        alone.append(largest[len(alone)]["text_sha256"])
    rest = groups.where(~F.col("text_sha256").isin(alone)) if alone else groups
    starts = _partition(rest, shards - len(alone)) if left else []
    key = F.col("text_sha256")
    shard = sum(((key >= s).cast("int") for s in starts), F.lit(len(alone)))
    for k, sha in enumerate(alone):
        shard = F.when(key == sha, k).otherwise(shard)
    return _numbered(rows.withColumn("shard", shard), total[1] or 0, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``: rows are numbered in parts by a hash of the id, and each part starts where the ones before end."""
    parts = max(1, -(-total // (shards * SLOT_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("text_sha256", "doc_id"))
    numbered = rows.withColumn("within", within).join(sizes.select("shard", "part", before.alias("before")), ["shard", "part"])
    return numbered.withColumn("slot", (F.col("before") + F.col("within") - 1).cast("bigint"))
