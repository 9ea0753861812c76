"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its ``LENGTH``
nearest pivots in order and posted in the inverted file of each of them.  A query reads
the files of its own nearest pivots, a fixed share of all, so that the share of the vectors
that it meets does not shrink as pivots grow; what is in them is ranked by Spearman's footrule
between the two orders, and the nearer half is reranked by exact inner product.

Files and queries meet by a shuffle on the pivot; a large file is split into parts, and
its queries go to each.  Equal vectors are indexed once, with the smallest of their ids,
so that copies of one vector do not crowd out everything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertloom.llm.tables import checkpointed

NEAREST = 20
QUERY_STEP = 20
# Nearest pivots that represent a vector.
LENGTH = 20
# Share of the pivots whose files a query reads, LENGTH at least.
READ_SHARE = 1 / 9
# Pivots per square root of the number of vectors, and the most there are (at 1,024 dimensions 128 MB).
PIVOTS_PER_ROOT = 0.8
MAX_PIVOTS = 16_384
# Of the candidates in one part of an inverted file, the share that is reranked, and how many at least.
RERANKED = 0.5
LEAST_RERANKED = 512
# Postings in one part of an inverted file, about.
PART_POSTINGS = 20_000
# Queries that are ranked against a part in one numpy step.
QUERY_BLOCK = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null, infinite or undefined components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1)


def _orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first, equals by number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int32)


def _places(orders: np.ndarray, pivots: int) -> np.ndarray:
    """The place of each pivot in each order, its length for pivots that are not in it."""
    places = np.full((len(orders), pivots), orders.shape[1], np.int32)
    np.put_along_axis(places, orders, np.arange(orders.shape[1], dtype=np.int32)[None, :], axis=1)
    return places


def footrule(place: np.ndarray, orders: np.ndarray, length: int) -> np.ndarray:
    """Footrule distance from a query (its places in an order of ``length``) to each of ``orders``, less a constant.

    A pivot that is missing from an order counts as being at place ``length``.  Only pivots in both
    orders bring two orders nearer to each other, by twice their places' distance from there.
    """
    later = np.maximum(place[orders], np.arange(orders.shape[1], dtype=np.int32)[None, :])
    return -2 * (length - later).sum(axis=1)


def _distinct(vectors: DataFrame, nearest: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, vec_id, vector) with usable vectors of the common dimension; and distinct vectors with their smallest ids."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (most["d"] if most else 0)).withColumn("key", F.sha2(F.col("vector").cast("string"), 256))
    # Only so many ids of equal vectors can be among the nearest; the limit applies before the shuffle.
    place = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= nearest + 1)
    return rows, few.groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.any_value("vector").alias("vector"))


def _posted(distinct: DataFrame, pivots: np.ndarray, length: int, read: int) -> DataFrame:
    """``distinct`` with ``order``: the nearest pivots of each vector, and ``reads``: more of them, for queries only."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                found = _orders(_matrix(some.column("vector"), np.float64), shared.value, read)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found[:, :length].ravel()), length).cast(pa.list_(pa.int32()))
                reads = pa.array([f if asked else None for f, asked in zip(found, some.column("asked").to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists, reads], [*some.schema.names, "order", "reads"])

    schema = "key string, ids array<bigint>, vector array<double>, asked boolean, `order` array<int>, reads array<int>"
    return distinct.select("key", "ids", "vector", "asked").mapInArrow(order, schema)


def _search(pivots: int, nearest: int):
    """Ranks the queries of each cell (pivot, part) against its postings; rows come by cell, postings first."""

    def best(queries: pa.RecordBatch, keys: np.ndarray, vectors: np.ndarray, orders: np.ndarray) -> pa.RecordBatch:
        asked = _matrix(queries.column("vector"), np.float64)
        own = _matrix(queries.column("order"), np.int32)
        places = _places(own, pivots)
        scores = asked @ vectors.T
        keep = max(LEAST_RERANKED, int(len(keys) * RERANKED))
        out_query, out_key, out_score = [], [], []
        for k, name in enumerate(queries.column("key").to_pylist()):
            near = np.arange(len(keys))
            if len(keys) > keep:
                near = np.argpartition(footrule(places[k], orders, own.shape[1]), keep - 1)[:keep]
            if len(near) > nearest + 8:
                near = near[np.argpartition(-scores[k, near], nearest + 7)[: nearest + 8]]
            # Summed in one fixed way, whatever block a pair was met in.
            exact = (vectors[near] * asked[k]).sum(axis=1)
            chosen = np.lexsort((keys[near], -exact))[: nearest + 1]
            out_query += [name] * len(chosen)
            out_key.append(keys[near][chosen])
            out_score.append(exact[chosen])
        columns = [pa.array(out_query, pa.string()), pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_score))]
        return pa.RecordBatch.from_arrays(columns, ["asker", "first_id", "score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for part in parts:
            marks = np.stack([np.asarray(part.column(c)) for c in ("pivot", "part", "query")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own, some = tuple(marks[a, :2].tolist()), part.slice(a, b - a)
                if own != cell:
                    cell, held, ready = own, [], None
                if not marks[a, 2]:
                    held.append(some)
                    continue
                if ready is None and held:
                    columns = [pa.concat_arrays([h.column(c) for h in held]) for c in ("first_id", "vector", "order")]
                    ready = (np.asarray(columns[0]), _matrix(columns[1], np.float64), _matrix(columns[2], np.int32))
                    held = []
                if ready:
                    for at in range(0, some.num_rows, QUERY_BLOCK):
                        yield best(some.slice(at, QUERY_BLOCK), *ready)

    return run


def nearest_neighbours(vectors: DataFrame, step: int = QUERY_STEP, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` vectors of each query by inner product, nearest first.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.  Queries are the
    rows whose id is divisible by ``step``; their candidates are all rows with other ids.  Equal
    scores are ordered by id.  Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows without an id or of another dimension than most.  A repeated row
    (same id and vector) counts once.  Fewer candidates than ``nearest`` are all returned.  An
    empty table gives an empty result.
    """
    rows, distinct = _distinct(vectors, nearest)
    rows = rows.where(F.col("vec_id") % step == 0).select("key", "vec_id").distinct()
    asked = rows.select("key", F.lit(True).alias("asked")).distinct()
    distinct = checkpointed(distinct.join(asked, "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    number = distinct.count()
    length = min(LENGTH, max(1, number))
    wanted = min(number, MAX_PIVOTS, max(length, round(PIVOTS_PER_ROOT * math.sqrt(number))))
    # The keys are hashes, so that their order is a random one that does not change between runs.
    pivots = np.array([r["vector"] for r in distinct.orderBy("key").limit(max(1, wanted)).select("vector").collect()])
    if len(pivots):
        pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    read = max(length, round(READ_SHARE * len(pivots)))
    posted = checkpointed(_posted(distinct, pivots, length, read))
    sizes = posted.select(F.explode("order").alias("pivot")).groupBy("pivot").agg(
        F.ceil(F.count(F.lit(1)) / PART_POSTINGS).cast("int").alias("parts")
    )
    posts = lambda rows, order: rows.select(
        F.explode(order).alias("pivot"), F.col("ids")[0].alias("first_id"), "key", "vector", F.col(order).alias("order")
    ).join(F.broadcast(sizes), "pivot")
    cell = lambda part, query: ["pivot", part.cast("int").alias("part"), F.lit(query).alias("query"), "key", "first_id", "vector", "order"]
    files = posts(posted, "order").select(*cell(F.pmod(F.xxhash64("key"), F.col("parts")), 0))
    queries = posts(posted.where("asked"), "reads").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*cell(F.col("part"), 1))
    cells = files.unionByName(queries).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "query")
    met = cells.mapInArrow(_search(len(pivots), nearest), "asker string, first_id bigint, score double")
    ranked = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = met.groupBy("asker", "first_id").agg(F.max("score").alias("score"))
    found = found.withColumnRenamed("first_id", "vec_id").withColumn("place", F.row_number().over(ranked))
    found = found.where(F.col("place") <= nearest + 1).select("asker", F.col("vec_id").alias("first_id"), "score")
    members = distinct.select(F.col("ids")[0].alias("first_id"), "ids")
    found = found.join(members, "first_id").select("asker", F.explode("ids").alias("vec_id"), "score")
    found = found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= nearest + 1)
    answers = rows.select(F.col("vec_id").alias("query_id"), F.col("key").alias("asker")).join(found.drop("place"), "asker")
    order = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    answers = answers.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order))
    return answers.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
