"""Equal parts of an order, from sampled bounds.

Rows that are ordered by a key and a time are cut into parts of about equal depth,
whatever the keys and however many rows share a time or have none: bounds are rows of a
bounded sample, and a row's part is found by binary search among them.  A hot key, a
burst or rows without a time span many parts; small keys share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts per shuffle partition, so that parts that meet in one partition even out.
PARTS_PER_PARTITION = 4
# Most parts, rows sampled for each, and fewest rows that are worth a part.
MAX_PARTS = 4096
SAMPLES = 32
LEAST_ROWS = 2000
_RANGE = 1 << 30


def part_of(rows: DataFrame, place: list[Column], part_rows: int | None = None) -> Column:
    """The part, 0 and up, that each row of ``rows`` is in by the order of ``place``; NULLs come first.

    Counts the rows and draws the sample by hash at once, both over the columns of
    ``place`` alone.  ``part_rows`` asks for parts of that size; without it their number
    follows the session's shuffle partitions.  Rows alike in ``place`` share a part.
    """
    names = [f"p{k}" for k in range(len(place))]
    # Zero, but not a constant, which Spark would drop from partitionings that others then fail to match.
    one = F.coalesce(F.pmod(F.xxhash64(*place), F.lit(1)).cast("int"), F.lit(0))
    places = rows.select(*[column.alias(name) for column, name in zip(place, names)])
    total = places.count()
    wanted = PARTS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MAX_PARTS, -(-total // (part_rows or LEAST_ROWS)), *([] if part_rows else [wanted]))
    if wanted <= 1:
        return one
    share = min(1.0, SAMPLES * wanted / total)
    drawn = places.where(F.pmod(F.xxhash64(*names), F.lit(_RANGE)) < int(share * _RANGE)).collect()
    drawn.sort(key=lambda r: [(v is not None, v) for v in r])
    step = max(1, len(drawn) // wanted)
    cuts = list(dict.fromkeys(tuple(r) for r in drawn[step::step]))
    if not cuts:
        return one
    kinds = [field.dataType for field in places.schema]
    literal = lambda cut: F.struct(*[F.lit(v).cast(kind).alias(name) for v, kind, name in zip(cut, kinds, names)])
    bounds = F.array(*map(literal, cuts))
    own = F.struct(*[column.alias(name) for column, name in zip(place, names)])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    further = lambda at, by: F.when(F.get(bounds, at + by - 1) <= own, at + by).otherwise(at)
    # Never NULL, and known not to be: joins on it would filter one reader of the rows and not the other.
    return F.coalesce(F.aggregate(steps, F.lit(0), further), F.lit(0))
