"""Grouping keys that may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(keys: list[str]) -> Column:
    """One non-NULL text per combination of keys, a NULL key included.

    Windows, aggregations and joins on this one column agree on the partitioning,
    so they share a shuffle; an equality join on the keys themselves would lose
    rows whose key is NULL.
    """
    if not keys:
        return F.lit("")
    text = lambda k: F.col(k).cast("string")
    return F.concat_ws(
        ",", *[F.coalesce(F.concat(F.length(text(k)).cast("string"), F.lit(":"), text(k)), F.lit("-")) for k in keys]
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
