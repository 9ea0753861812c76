"""Newest-N per key without pulling a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.operators.keys import join_null_safe

# Up to this rank Spark trims each map task's rows before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_RANK_LIMIT = 1000


def _descending(order: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def newest(df: DataFrame, order: list[str], n: int, keys: list[str]) -> DataFrame:
    """The ``n`` greatest rows by ``order``, per key; ``order`` must be unique per key.

    Up to 1,000 rows the rank limit runs before the shuffle.  Beyond that, row
    counts per bucket of the first order column locate the bucket in which the
    n-th row lies; newer buckets are kept whole and only that bucket is ranked.
    """
    if n <= 0:
        return df.limit(0)
    if n > MAP_SIDE_RANK_LIMIT:
        return _newest_by_counts(df, order, n, keys)
    if not keys:
        return df.orderBy(*_descending(order)).limit(n)
    spec = Window.partitionBy(*keys).orderBy(*_descending(order))
    return df.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= n).drop("_rank")


def _bucket(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("minute", column)
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / 1024)
    return F.col(column)


def _newest_by_counts(df: DataFrame, order: list[str], n: int, keys: list[str]) -> DataFrame:
    bucketed = df.withColumn("_bucket", _bucket(df, order[0]))
    newer_first = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc())
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cut = (
        counts.withColumn(
            "_newer", F.coalesce(F.sum("_n").over(newer_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .where(F.col("_newer") < n)
        .groupBy(*keys)
        .agg(F.max_by(F.struct("_bucket", "_newer"), "_newer").alias("_cut"))
    )
    if keys:
        candidates = join_null_safe(bucketed, cut, keys)
    else:
        candidates = bucketed.withColumn("_cut", cut.scalar())
    # A missing first order value is older than any other, in a bucket as in a descending sort.
    bucket, cut_at = F.col("_bucket"), F.col("_cut._bucket")
    newer = F.coalesce(bucket > cut_at, bucket.isNotNull() & cut_at.isNull())
    candidates = candidates.where(newer | bucket.eqNullSafe(cut_at))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*_descending(order))
    return (
        candidates.withColumn("_rank", F.row_number().over(in_bucket))
        .where(newer | (F.col("_rank") <= n - F.col("_cut._newer")))
        .select(*df.columns)
    )
