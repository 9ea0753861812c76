"""Merkle manifest of a dataset, with nodes labelled by the leaf ranks they cover.

Rows are leaves.  The leaves of a tree (one per language) are numbered by a sort over
range partitions: a row's rank is its place in its partition plus what the partitions
before hold, and only the partitions' counts are ever gathered.  A node of level k covers
an interval ``lo..hi`` of ranks; its parent covers the interval of level k + 1 around it,
and what the parent covers beside the node's own interval is its siblings' (none at the
end of a level with an odd number of nodes).

Levels are bucketed by ``SPAN``: a bucket holds the nodes of one level that share an
ancestor ``SPAN`` levels up, 2 ** SPAN at most, and all levels between.  Going up, a
bucket becomes one node of the next bucketed level.  Going down, each bucket is joined
with the node it became, whose interval contains those of all its leaves, and takes over
the siblings of that node's ancestors.  So the joins are on (tree, interval of the
bucket), no key has more than 2 ** SPAN rows, and their number shrinks by 2 ** SPAN from
one join to the next.  Digests only move; texts never leave the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.tables import checkpointed

# Levels in one bucket.
SPAN = 8
# Rows that one range partition holds, about, when leaves are numbered.
PART_ROWS = 1_000_000

_STEP = "struct<level:int,lo:bigint,hi:bigint,left:boolean,digest:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def numbered(rows: DataFrame, tree: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` (checkpointed) with ``lo``, the rank within ``tree`` by ``order``, and ``n``, the rows of the tree.

    Nulls come first.  Rows alike in all these columns get ranks in any order.  ``parts`` is the
    number of range partitions; without it they hold ``PART_ROWS`` rows.
    """
    parts = max(1, -(-rows.count() // PART_ROWS)) if parts is None else parts
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ranged = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    place = F.monotonically_increasing_id()
    ranged = ranged.select("*", F.shiftright(place, 33).alias("part"), place.alias("place"))
    counts = ranged.groupBy("part", tree).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    within = Window.partitionBy(tree)
    before = F.sum("held").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.col(tree).alias("of"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"), F.sum("held").over(within).alias("n"))
    # One row for each partition and tree in it.
    found = ranged.join(starts, (starts["part"] == ranged["part"]) & F.col(tree).eqNullSafe(F.col("of")))
    return found.select(*[ranged[c] for c in rows.columns], (F.col("place") + F.col("start")).cast("bigint").alias("lo"), F.col("n").cast("bigint").alias("n"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves; exact for any number."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _above(nodes: Column) -> Column:
    """The level above: every two consecutive digests become one, a last one alone too."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda k: digest(F.get(nodes, k * 2), F.coalesce(F.get(nodes, k * 2 + 1), F.lit(""))))


def _bucketed(items: DataFrame, base: int, span: int) -> DataFrame:
    """Items (tree, n, lo, digest, payload) of level ``base`` by bucket, with the digests of all levels within.

    ``levels`` has one array of digests for each level from ``base`` to the bucket's top.
    """
    top = F.least(F.lit(span), F.col("height") - base)
    rows = items.withColumn("bucket", F.shiftright("lo", base + span)).groupBy("tree", "bucket").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("lo", "digest", "payload"))).alias("items")
    )
    rows = rows.select("tree", "bucket", "n", "items", _height(F.col("n")).alias("height"), F.col("items.digest").alias("level_0"))
    for k in range(1, span + 1):
        below = F.col(f"level_{k - 1}")
        rows = rows.withColumn(f"level_{k}", F.when(F.lit(k) <= top, _above(below)))
    levels = F.filter(F.array(*[F.col(f"level_{k}") for k in range(span + 1)]), lambda x: x.isNotNull())
    return rows.select("tree", "bucket", "n", "height", "items", levels.alias("levels"))


def _left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, by if isinstance(by, Column) else F.lit(by))


def _right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def _siblings(base: int, lo: Column, levels: Column, bucket: Column, n: Column, span: int) -> Column:
    """For each level below a bucket's top, the sibling of the node around rank ``lo``: its side, interval and digest.

    Where the parent covers no more than the node itself, the interval is null and the digest empty.
    """

    def step(level: Column) -> Column:
        width = _left(F.lit(1).cast("bigint"), level)
        own = _left(_right(lo, level), level)
        own_end = F.least(own + width, n) - 1
        parent = _left(_right(lo, level + 1), level + 1)
        parent_end = F.least(parent + width * 2, n) - 1
        left = parent < own
        some = left | (own_end < parent_end)
        start, end = F.when(left, parent).when(some, own_end + 1), F.when(left, own - 1).when(some, parent_end)
        first = _left(bucket, base + span)
        found = F.get(F.get(levels, level - base), _right(start - first, level).cast("int"))
        return F.struct(
            level.cast("int").alias("level"), start.alias("lo"), end.alias("hi"), left.alias("left"), F.coalesce(found, F.lit("")).alias("digest")
        )

    count = F.size(levels) - 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(base), F.lit(base) + count - 1), step)).otherwise(F.array().cast(f"array<{_STEP}>"))


class Trees:
    """The trees over ``leaves`` (tree, lo, n, digest, payload), by buckets; each bucketed level is a checkpointed table."""

    def __init__(self, leaves: DataFrame, span: int = SPAN, parts: int | None = None):
        self.span, self.parts = span, parts or int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = leaves.agg(F.max("n")).first()[0] or 0
        strata = max(1, math.ceil(max(0, most - 1).bit_length() / span))
        self.buckets: list[DataFrame] = []
        items = leaves
        for k in range(strata):
            held = checkpointed(self._fewer(_bucketed(items.withColumn("height", _height(F.col("n"))), k * span, span), k))
            self.buckets.append(held)
            if k + 1 < strata:
                more = held.where(F.col("height") > (k + 1) * span)
                items = more.select(
                    "tree", F.shiftleft("bucket", (k + 1) * span).alias("lo"), "n", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"),
                    F.lit(None).alias("payload"),
                )

    def _fewer(self, rows: DataFrame, k: int) -> DataFrame:
        """Rows of stratum ``k`` in as many fewer partitions as they are fewer than the leaves."""
        return rows.coalesce(max(1, self.parts >> (k * self.span))) if k else rows

    def _tops(self, k: int) -> Column:
        """Whether a bucket of stratum ``k`` ends its tree."""
        return F.col("height") <= (k + 1) * self.span

    def roots(self) -> DataFrame:
        """tree, n and root of every tree."""
        found = [
            held.where(self._tops(k)).select("tree", "n", F.get(F.element_at("levels", -1), F.lit(0)).alias("root")) for k, held in enumerate(self.buckets)
        ]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def nodes(self) -> DataFrame:
        """tree, level, lo, hi, digest of every node, leaves included."""
        rows = None
        for k, held in enumerate(self.buckets):
            base = k * self.span
            # The top level of a bucket is the bottom level of the next one, unless it ends the tree.
            level = held.select("tree", "bucket", "n", self._tops(k).alias("top"), F.size("levels").alias("count"), F.posexplode("levels").alias("k", "digests"))
            level = level.where(F.col("top") | (F.col("k") < F.col("count") - 1))
            node = level.select("tree", "n", (F.col("k") + base).alias("level"), "bucket", F.posexplode("digests").alias("place", "digest"))
            lo = F.shiftleft(F.col("bucket"), base + self.span) + _left(F.col("place").cast("bigint"), F.col("level"))
            hi = F.least(lo + _left(F.lit(1).cast("bigint"), F.col("level")), F.col("n")) - 1
            found = node.select("tree", "level", lo.alias("lo"), hi.alias("hi"), "digest")
            rows = found if rows is None else rows.unionByName(found)
        return rows

    def proofs(self, above: DataFrame) -> DataFrame:
        """tree, lo, digest, payload, proof and ``above``'s columns for every leaf.

        ``above`` has a row for each tree: tree, path (the siblings above its root) and more.
        """
        extra = [c for c in above.columns if c not in ("tree", "path")]
        of_tree = above.select(F.col("tree").alias("of"), F.col("path").alias("beyond"), *extra)
        below = None
        for k in range(len(self.buckets) - 1, -1, -1):
            held, base = self.buckets[k], k * self.span
            # A tree has one bucket on top, so that few rows meet the trees' own.
            rows = held.where(self._tops(k)).join(of_tree, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
            if below is not None:
                inner = held.where(~self._tops(k)).join(
                    below.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("node"))
                )
                rows = rows.unionByName(inner.drop("of", "node"))
            item = rows.select("tree", "bucket", "n", "levels", "beyond", *extra, F.explode("items").alias("item"))
            path = F.concat(_siblings(base, F.col("item.lo"), F.col("levels"), F.col("bucket"), F.col("n"), self.span), F.col("beyond"))
            found = item.select("tree", F.col("item.lo").alias("lo"), F.col("item.digest").alias("digest"), F.col("item.payload").alias("payload"), path.alias("proof"), *extra)
            if k == 0:
                return found
            below = checkpointed(self._fewer(found.select("tree", F.shiftright("lo", base).alias("node"), F.col("proof").alias("beyond"), *extra), k))


def folded(start: Column, proof: Column) -> Column:
    """The digest that ``start`` and the siblings of ``proof`` lead to."""
    return F.aggregate(
        proof, start, lambda at, step: F.sha2(F.when(step["left"], F.concat(step["digest"], at)).otherwise(F.concat(at, step["digest"])), 256)
    )


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides the CRC-32 of the id's decimal text; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, rank, leaf, subroot, root, proof, tampered_leaf.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns are ignored.  Nulls
    are hashed as ``-``; null languages have a tree of their own, which comes first, and null
    ids come first in theirs.  Equal ids are ordered by their leaves; of rows alike in all
    columns each has a proof of its own.  Texts of any length are hashed where they are
    read.  ``proof`` has a step (level, interval, side, digest) for each level up to the
    dataset's root, levels of the tree over the languages included, whose intervals count
    languages; a step without a sibling has null bounds and an empty digest.
    ``tampered_leaf`` is the leaf with one more in n_chars where ``tampered`` says so, else
    the leaf.  An empty table gives an empty result.
    """
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    bad = F.when(tampered(F.col("doc_id")), leaf(**columns | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}))
    rows = checkpointed(docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(**columns).alias("digest"), bad.alias("bad"),
    ))
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = numbered(rows, "tree", ["doc_id", "digest"], max(wide, -(-rows.count() // PART_ROWS)))
    trees = Trees(leaves.select("tree", "lo", "n", "digest", F.struct("doc_id", "bad").alias("payload")), span)

    # A row for each language: few files, unless languages are as many as rows.
    subroots = trees.roots().select(F.lit(0).alias("all"), F.col("tree").alias("lang"), F.col("root").alias("digest"))
    langs = subroots.count()
    few = max(1, -(-langs // PART_ROWS))
    ranked = numbered(checkpointed(subroots.coalesce(few)), "all", ["lang"], few)
    upper = Trees(ranked.select(F.col("all").alias("tree"), "lo", "n", "digest", F.struct("lang").alias("payload")), span, few)
    top = upper.roots().select("tree", F.array().cast(f"array<{_STEP}>").alias("path"), "root")
    of_lang = checkpointed(upper.proofs(top).select(
        F.col("payload.lang").alias("tree"), F.col("proof").alias("path"), F.col("digest").alias("subroot"), "root"
    ).coalesce(few))
    found = trees.proofs(of_lang)
    return found.select(
        F.col("payload.doc_id").alias("doc_id"), F.col("tree").alias("lang"), F.col("lo").alias("rank"), F.col("digest").alias("leaf"), "subroot", "root", "proof",
        F.coalesce("payload.bad", "digest").alias("tampered_leaf"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """``manifest``'s rows checked: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    siblings = F.concat_ws("", F.transform("proof", lambda step: step["digest"]))
    rows = rows.select("*", folded(F.col("tampered_leaf"), F.col("proof")).alias("folded_root"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
