"""Embedding near-dedup through a forest of random-projection trees.

Equal vectors of one label collapse first, with map-side combining.  Each tree splits the
vectors of a label again and again: level k of a tree has one random direction, a node
splits at the median of its projections, and vectors within a margin of the median go to
both sides (spill).  A node that a direction does not divide (a dense cluster, narrower
than the margin) is tried with the next ones and then stays whole.  Leaves aim at
``LEAF_ROWS`` vectors.

The medians come from a sample of at most ``SAMPLE_ROWS`` vectors, so that the broadcast
forest is bounded whatever the input; every vector goes through every tree.  Where the
sample is too thin to split on, the medians of its last node serve the levels below too:
these nodes are named by the side taken at each level and need no table.

All pairs within a leaf are verified.  A pair that meets in several leaves counts in the
first of them only; each vector carries the names of its leaves, so that no pair has to be
emitted or made distinct.  A task emits sums and links that span what it found connected.
Leaves over ``PART_ROWS`` are cut into parts, and each two parts meet in a cell of their
own, so that a dense cluster of any size is compared whole by many tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.simhash import components
from alertloom.llm.tables import checkpointed

THRESHOLD = 0.93
TREES = 6
SEED = 12
# Margin on each side of a median, in units of the projected distance of a pair at the threshold.
SPILL = 0.4
# Vectors in a leaf at most, as estimated from the sample.
LEAF_ROWS = 512
# Vectors on which medians are taken at most, and their components; they bound driver memory and the broadcast.
SAMPLE_ROWS = 32_768
SAMPLE_COMPONENTS = 4_000_000
# Fewest sampled vectors on which a node is split, and the largest share of them that one side may get.
SPLIT_ROWS = 16
WIDEST = 0.8
# Directions tried in a row on a node that none divides.
TRIES = 4
# Vectors of a leaf that meet in one block; larger leaves are cut into parts.
PART_ROWS = 1024

_TREE_BITS, _NODE_BITS, _TAIL_BITS = 8, 24, 31


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link: a label, and a vector that is neither null, empty nor zero and has finite components only."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    good = F.forall(vector, lambda x: F.coalesce(number(x), F.lit(False))) & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(label.isNotNull() & good, F.lit(False))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; components of any size are scaled before they are squared."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _direction(tree: int, level: int, size: int) -> np.ndarray:
    found = np.random.default_rng([SEED, tree, level, size]).normal(size=size)
    return found / np.sqrt(found @ found)


class Forest:
    """Trees over the vectors of each root (a label and a length) that has more rows than a leaf.

    ``roots`` maps (tree, root) to a node.  A node is either a split (level, cut, left, right) or
    a leaf, whose ``tail`` are the (level, cut) of the unnamed levels below.
    """

    def __init__(self, trees: int, threshold: float, leaf_rows: int):
        self.trees, self.leaf_rows = trees, leaf_rows
        self.reach = math.sqrt(2 - 2 * threshold) * SPILL
        self.roots: dict[tuple[int, str], int] = {}
        self.level: list[int] = []
        self.cut: list[float] = []
        self.sides: list[tuple[int, int]] = []
        self.tails: dict[int, list[tuple[int, float]]] = {}

    def margin(self, size: int) -> float:
        return self.reach / math.sqrt(size)

    def grow(self, root: str, sample: np.ndarray, weight: float) -> None:
        """Adds the trees of ``root``; each sampled vector stands for ``weight`` rows."""
        if len(sample) < SPLIT_ROWS or len(sample) * weight <= self.leaf_rows:
            return
        for tree in range(self.trees):
            projected: dict[int, np.ndarray] = {}

            def on(level: int, tree: int = tree, projected: dict = projected) -> np.ndarray:
                if level not in projected:
                    projected[level] = sample @ _direction(tree, level, sample.shape[1])
                return projected[level]

            self.roots[tree, root] = self._node(on, np.arange(len(sample)), 0, weight, self.margin(sample.shape[1]))

    def _dividing(self, on, rows: np.ndarray, level: int, margin: float) -> tuple[int, float] | None:
        """The first level from ``level`` on, and its cut, that leaves neither side nearly all of ``rows``."""
        for found in range(level, level + TRIES):
            values = on(found)[rows]
            cut = float(np.median(values))
            if max((values < cut + margin).sum(), (values > cut - margin).sum()) <= WIDEST * len(rows):
                return found, cut
        return None

    def _node(self, on, rows: np.ndarray, level: int, weight: float, margin: float) -> int:
        node = len(self.level)
        self.level.append(-1)
        self.cut.append(0.0)
        self.sides.append((-1, -1))
        if len(rows) * weight <= self.leaf_rows:
            return node
        split = self._dividing(on, rows, level, margin)
        if split is None:
            return node
        found, cut = split
        values = on(found)[rows]
        low, high = rows[values < cut + margin], rows[values > cut - margin]
        if min(len(low), len(high)) >= SPLIT_ROWS:
            self.level[node], self.cut[node] = found, cut
            self.sides[node] = (self._node(on, low, found + 1, weight, margin), self._node(on, high, found + 1, weight, margin))
            return node
        tail, left = [], len(rows) * weight
        while left > self.leaf_rows and split and len(tail) < _TAIL_BITS:
            tail.append(split)
            left *= 0.6
            split = self._dividing(on, rows, split[0] + 1, margin)
        self.tails[node] = tail
        return node

    def leaves(self, root: str, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of each place that ``vectors`` (unit rows of one root) have, sorted by row and leaf."""
        rows, names = [], []
        count, size = vectors.shape
        margin = self.margin(size)
        for tree in range(self.trees):
            start = self.roots.get((tree, root))
            if start is None:
                # One leaf for the whole root, the same in every tree.
                rows.append(np.arange(count))
                names.append(np.zeros(count, np.int64))
                break
            projected: dict[int, np.ndarray] = {}

            def sides(level: int, cut: float, at: np.ndarray, tree: int = tree, projected: dict = projected) -> tuple[np.ndarray, np.ndarray]:
                if level not in projected:
                    projected[level] = np.einsum("ij,j->i", vectors, _direction(tree, level, size))
                values = projected[level][at]
                return values < cut + margin, values > cut - margin

            open_ = [(start, np.arange(count))]
            while open_:
                node, at = open_.pop()
                if not len(at):
                    continue
                if self.level[node] >= 0:
                    low, high = sides(self.level[node], self.cut[node], at)
                    open_ += [(self.sides[node][0], at[low]), (self.sides[node][1], at[high])]
                    continue
                path = np.zeros(len(at), np.int64)
                for bit, (level, cut) in enumerate(self.tails.get(node, ())):
                    low, high = sides(level, cut, at)
                    path = np.concatenate([path[low], path[high] | (1 << bit)])
                    at = np.concatenate([at[low], at[high]])
                rows.append(at)
                names.append((((tree << _NODE_BITS) | (node - start)) << _TAIL_BITS) | path)
        row, name = np.concatenate(rows), np.concatenate(names)
        order = np.lexsort((name, row))
        return row[order], name[order]


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def planted(rows: DataFrame, total: int, threshold: float = THRESHOLD, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> Forest:
    """The forest over ``rows`` (root, vector), ``total`` in all, from a sample by hash of at most ``SAMPLE_ROWS`` of them."""
    forest = Forest(trees, threshold, leaf_rows)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(SPLIT_ROWS, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // longest))
    share = min(1.0, 0.95 * most / max(1, total))
    drawn = F.pmod(F.xxhash64("root", "vector", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
    # A hash lets a few more through at times; the limit only keeps the bound certain.
    found = rows.where(drawn).select("root", "vector").limit(most).toArrow().combine_chunks()
    if not found.num_rows:
        return forest
    roots = found.column("root").to_pylist()
    places: dict[str, list[int]] = {}
    for place, root in enumerate(roots):
        places.setdefault(root, []).append(place)
    for root in sorted(places):
        vectors = found.column("vector").take(pa.array(places[root])).combine_chunks()
        size = int(root.partition(":")[0])
        distinct = np.unique(unit(_matrix(vectors, size)), axis=0)
        forest.grow(root, distinct, 1 / share)
    return forest


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each place, by a symmetric matrix of links."""
    found = np.arange(len(near))
    while True:
        least = np.minimum(found, np.where(near, found, len(found)).min(axis=1))
        # Whoever a place pointed to learns of the smaller one too.
        np.minimum.at(least, found, least)
        least = least[least]
        if np.array_equal(least, found):
            return found
        found = least


def compared(vectors: np.ndarray, parts: np.ndarray, copies: np.ndarray, leaves: list[list[int]], leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector that no earlier leaf has counted, with copies; and the smallest place it is connected to.

    With vectors of two parts only pairs across them count; pairs within a part meet in a cell of that part.
    """
    count = len(vectors)
    near = np.empty((count, count), bool)
    for a in range(0, count, 512):
        near[a : a + 512] = vectors[a : a + 512] @ vectors.T >= threshold
    if parts.min() != parts.max():
        near &= parts[:, None] != parts[None, :]
    # Rounding may differ between a block and its mirror image.
    near |= near.T
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return np.zeros(count, np.int64), np.arange(count)
    inner = near[np.ix_(linked, linked)]
    earlier = [(k, name) for k, row in enumerate(linked.tolist()) for name in leaves[row] if name < leaf]
    new = inner
    if earlier:
        names = np.unique(np.array([name for _, name in earlier]), return_inverse=True)[1]
        member = np.zeros((len(linked), names.max() + 1), np.float32)
        member[[k for k, _ in earlier], names] = 1
        new = inner & (member @ member.T == 0)
    links = np.zeros(count, np.int64)
    # Doubles hold these sums exactly up to 2 ** 53.
    links[linked] = (new.astype(np.float64) @ copies[linked].astype(np.float64)).astype(np.int64)
    root = np.arange(count)
    root[linked] = linked[_labels(inner)]
    return links, root


def _groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that share the values of ``keys``, two rows at least."""
    held: list[pa.RecordBatch] = []

    def cuts(rows: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, rows.num_rows - 1), bool)
        for key in keys:
            codes = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        return np.flatnonzero(change) + 1

    def whole(rows: pa.Table, bounds: list[int]) -> Iterator[pa.Table]:
        for a, b in itertools.pairwise(bounds):
            if b - a > 1:
                yield rows.slice(a, b - a)

    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        rows = pa.Table.from_batches(held).combine_chunks()
        found = cuts(rows).tolist()
        if found:
            yield from whole(rows, [0, *found])
            held = rows.slice(found[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from whole(rows, [0, *cuts(rows).tolist(), rows.num_rows])


def links(vectors: DataFrame, threshold: float = THRESHOLD, part_rows: int = PART_ROWS) -> DataFrame:
    """rep, links, root: for each leaf in which a vector links, its newly counted links and the least vector it is connected to.

    ``vectors`` has rep, root, vector, copies and leaves.
    """
    named = vectors.select("rep", F.col("root").alias("label"), "vector", "copies", "leaves", F.explode("leaves").alias("leaf"))
    sizes = vectors.select("root", F.explode("leaves").alias("leaf")).groupBy(F.col("root").alias("label"), "leaf").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > part_rows).select("label", "leaf", F.ceil(F.col("n") / part_rows).alias("parts"))
    rows = named.join(checkpointed(crowded), ["label", "leaf"], "left")
    # Part p of a crowded leaf is in the cells {p, q} of all parts q, itself included.
    parts = F.coalesce(F.col("parts"), F.lit(1))
    part = F.pmod(F.xxhash64("rep"), parts)
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda q: F.least(q, F.col("part")) * F.col("parts") + F.greatest(q, F.col("part")))
    rows = rows.withColumns({"parts": parts, "part": part}).withColumn("cell", F.explode(cells)).drop("parts")
    rows = rows.repartition("label", "leaf", "cell").sortWithinPartitions("label", "leaf", "cell", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["label", "leaf", "cell"]):
            size = int(group.column("label")[0].as_py().partition(":")[0])
            take = lambda name: group.column(name).combine_chunks()
            found, root = compared(
                unit(_matrix(take("vector"), size)), take("part").to_numpy(), take("copies").to_numpy(), take("leaves").to_pylist(),
                group.column("leaf")[0].as_py(), threshold,
            )
            rep = take("rep").to_numpy()
            told = np.flatnonzero((found > 0) | (root != np.arange(len(root))))
            yield pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(found[told]), pa.array(rep[root[told]])], ["rep", "links", "root"])

    return rows.mapInArrow(compare, "rep bigint, links bigint, root bigint")


def near_duplicates(
    rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Two rows link if their labels and lengths are equal and their cosine, in double precision,
    is at least ``threshold``.  Rows without a label and vectors that are null, empty, zero or
    hold null or non-finite components link with nothing.  Repeated rows link with each
    other.  ``component_id`` is the smallest id in the component, null only if no row of it
    has an id; ``kept`` tells whether the row's id is that.  Other columns are ignored.  An
    empty table gives an empty result.  Pairs are found with a probability that grows with
    ``trees``; none below the threshold is linked.
    """
    number = F.col(embedding).cast("array<float>" if isinstance(rows.schema[embedding].dataType, T.ArrayType)
                                   and isinstance(rows.schema[embedding].dataType.elementType, T.FloatType) else "array<double>")
    given = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), number.alias("vector"), F.col(label).alias("label"))
    good = usable(F.col("vector"), F.col("label"))
    root = F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string"))
    linkable = given.where(good).select("vec_id", root.alias("root"), "vector")
    alone = given.where(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))

    forest = planted(linkable, linkable.count(), threshold, trees, leaf_rows)
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    distinct = linkable.groupBy("root", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("root").dictionary_encode()
            kind = codes.indices.to_numpy(zero_copy_only=False)
            row, name = [], []
            for k, found in enumerate(codes.dictionary.to_pylist()):
                at = np.flatnonzero(kind == k)
                where, leaf = trees_of.leaves(found, unit(_matrix(batch.column("vector").take(pa.array(at)), int(found.partition(":")[0]))))
                row.append(at[where])
                name.append(leaf)
            row, name = np.concatenate(row), np.concatenate(name)
            order = np.argsort(row, kind="stable")
            first = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            leaves = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(name[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], [*batch.schema.names, "leaves"])

    schema = T.StructType([*distinct.schema.fields]).add("leaves", T.ArrayType(T.LongType()))
    vectors = checkpointed(distinct.mapInArrow(placed, schema)).withColumn("rep", F.monotonically_increasing_id())
    found = checkpointed(links(vectors, threshold, part_rows))

    edges = found.where("root != rep").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    joined = components(edges)
    members = joined.unionByName(joined.select(F.col("root").alias("member"), "root").distinct())
    ids = vectors.select("rep", "least", "copies")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_member = members.join(ids, F.col("member") == F.col("rep")).select("member", F.col("root").alias("component"), "least")
    least = of_member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_member.join(least, "component").join(sums, F.col("member") == F.col("rep"), "left").select("member", "component_id", "links")
    # Written out, so that a vector with very many copies meets a plain table and its side can be split.
    facts = checkpointed(
        vectors.join(named, F.col("member") == F.col("rep"), "left").select(
            "root", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("member").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    all_rows = linkable.join(facts, ["root", "vector"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return all_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
