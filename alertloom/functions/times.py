"""Time arithmetic on either timestamp type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch; a time without zone is read in the session's zone."""
    column = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(column.cast("timestamp"))


def moment(time: Column | str, seq: Column | str) -> Column:
    """Order of ``(time, seq)`` as one DECIMAL, for ``seq`` of 0 and above.

    Aggregates over plain numbers stay hash aggregates; a struct as the ordering
    of ``max_by`` would make Spark sort the rows first.
    """
    number = F.col(seq) if isinstance(seq, str) else seq
    return micros(time).cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + number.cast("decimal(19,0)")
