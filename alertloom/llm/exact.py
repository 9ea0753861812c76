"""Exact dedup by heavy-hitter split, in DataFrame operations only.

A Misra-Gries pass (``freqItems``, whose summary keeps ``1 / support`` counters per
task and merges) names every digest that at least ``support`` of all rows have.
Their exact winners are aggregated with map-side combining, and that table of at
most ``1 / support`` rows is broadcast: rows of frequent digests never shuffle.
All other digests are shuffled in the ordinary way; none of them has more than
``support`` of the rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.tables import checkpointed, keep_rows

# Share of all rows from which a digest counts as frequent; bounds the broadcast to 500 rows.
SUPPORT = 0.002

# Below every id, so that rows without an id lose against all others.
NO_ID = -(2**63)


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names.  Texts are equal if they are after lower-casing A-Z; null is the empty
    text.  The row with the largest id stays.  Of rows that repeat text and id, one
    stays.  A row without an id stays only if no row of its group has one; then
    ``keep_id`` is null.  An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id()
    # One sortable number for (id, row): ids may repeat, the numbers may not.
    number = lambda c: c.cast("decimal(19,0)")
    order = number(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))) * number(F.lit(str(2**63))) + number(row)
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            digest(F.col("text")).alias("text_sha256"),
            order.cast("decimal(38,0)").alias("place"),
        )
    )
    winner = (
        F.max("doc_id").alias("keep_id"),
        F.max("place").alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    candidates = rows.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    frequent = (
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(*winner).where(F.col("group_size") > 1)
    )
    marked = rows.join(F.broadcast(frequent), "text_sha256", "left")
    rest = marked.where(F.col("group_size").isNull()).select(*rows.columns)
    rest = rest.join(rest.groupBy("text_sha256").agg(*winner), "text_sha256")
    return (
        marked.where(F.col("group_size").isNotNull()).unionByName(rest)
        .select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("best")).alias("kept"), "text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``groups``."""
    decided = checkpointed(groups(docs))
    identity = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    kept = (
        decided.groupBy(identity.alias("id"), F.col("text_sha256").alias("sha"))
        .agg(F.count(F.lit(1)).alias("copies"), F.max("kept").alias("stays")).where("stays")
    )
    return keep_rows(docs, {"id": identity, "sha": digest(F.col("text"))}, kept)
