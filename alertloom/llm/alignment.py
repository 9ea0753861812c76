"""Cross-tokenizer alignment by galloping intersection.

Every text is encoded by two tokenizers: A byte-level BPE (a space, then the text) and B
SentencePiece (which puts the space there itself).  The byte offsets at which tokens end
are two sorted lists; offsets in both cut the text into groups of tokens that cover the
same bytes.  The shorter list drives: each of its offsets gallops (steps that double, then
a binary search) from where an offset before it landed in the longer list.  In an Arrow
slice all texts' lists lie end to end, every 4096th offset gallops first, then every
256th, 16th and all others, each from the landing place of the one before it, so that numpy
takes many offsets at once and a step is as short as the texts' local differences.
The places of the common offsets slice the groups, and the differences of their ranks are
the ranges of tokens that cover each other.

Id pairs that end together are counted over the whole corpus, within tasks first.
Frequent pairs (``TABLE_PAIRS`` at most, whatever the corpus) are broadcast with their
counts; all rarer ones are joined, and none of them is a hot key, for all are rarer than
the broadcast ones.  Texts are encoded once and never move; their pairs are checkpointed.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm import pieces
from alertloom.llm.tables import checkpointed, slices

# Pairs whose counts are broadcast at most; 17 bytes each.
TABLE_PAIRS = 1 << 20
# Pairs of one text in a row; longer texts have several rows between the two passes.
ROW_PAIRS = 1 << 20
# Distinct pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1 << 21
# Strides at which offsets gallop, coarse ones first.
STRIDES = (4096, 256, 16, 1)
# Runs without a change between white space and other signs from which the fast encoder gets slow.
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(byte if byte in printable else next(others)): byte for byte in range(256)}


class ByteLevel:
    """The vocabulary of a byte-level BPE file, its encoder, and the bytes of each id."""

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, signs = described["model"]["vocab"], _byte_signs()
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.parts = [b""] * size
        for token, number in added.items():
            self.parts[number] = token.encode()
        ranks = {}
        for token, number in vocabulary.items():
            if token not in added:
                self.parts[number] = bytes(map(signs.__getitem__, token))
                ranks[self.parts[number]] = number
        self.fast = self._fast(described, ranks)

    def _fast(self, described: dict, ranks: dict[bytes, int]):
        """An encoder by ranks, where the file says no more than ranks do; else None."""
        first = described["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first["add_prefix_space"] and not described["normalizer"]
        joined = ["".join(pair.split(" ") if isinstance(pair, str) else pair) for pair in described["model"]["merges"]]
        order = [described["model"]["vocab"][token] for token in joined]
        if not plain or order != sorted(order) or len(order) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        import tiktoken

        return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not _LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class Side:
    """What the alignment needs of a vocabulary: byte lengths, and ids in decimal."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.width = len(str(len(parts))) + 1
        self.digits = np.zeros((len(parts), self.width), np.uint8)
        for k in range(len(parts)):
            text = str(k).encode()
            self.digits[k, : len(text)] = np.frombuffer(text, np.uint8)
        self.digit_count = (self.digits > 0).sum(axis=1)


class Pair:
    """Both vocabularies in one worker."""

    def __init__(self, path_a: str, path_b: str):
        self.byte_level, self.words = ByteLevel(path_a), pieces.vocabulary(path_b)
        self.a, self.b = Side(self.byte_level.parts), Side(self.words.parts)
        self.base = len(self.b.parts)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text in A and B; none where their bytes are not those of a space and the text."""
        none = np.empty(0, np.int32)
        if not text:
            return none, none
        whole = " " + text
        a, b = self.byte_level.encode(whole), np.array(self.words.library.encode(text), np.int32)
        raw = whole.encode()
        if b"".join(map(self.a.parts.__getitem__, a.tolist())) != raw or b"".join(map(self.b.parts.__getitem__, b.tolist())) != raw:
            return none, none
        return a, b


@functools.cache
def pair(path_a: str, path_b: str) -> Pair:
    """One per worker and paths."""
    return Pair(path_a, path_b)


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of the ascending ``keys`` the place of the first element of ``into`` that is not smaller."""
    count, end = len(keys), len(into)
    found = np.zeros(count, np.int64)
    before = 0
    for stride in STRIDES:
        at = np.arange(0, count, stride)
        # The last offset found so far that is not behind this one; the first ones start in front.
        low = found[at - at % before] if before else np.zeros(len(at), np.int64)
        wanted = keys[at]
        # Everything in front of ``low`` is smaller than the key; ``high`` is not, or is the end.
        high = low.copy()
        step, open_ = 1, np.flatnonzero((high < end) & (into[np.minimum(high, end - 1)] < wanted))
        while len(open_):
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + step, end)
            step *= 2
            inside = open_[high[open_] < end]
            open_ = inside[into[high[inside]] < wanted[inside]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            smaller = into[middle] < wanted[open_]
            low[open_[smaller]] = middle[smaller] + 1
            high[open_[~smaller]] = middle[~smaller]
            open_ = open_[low[open_] < high[open_]]
        found[at] = low
        before = stride
    return found


class Aligned:
    """The texts of one slice: ids of both sides end to end, and the places of the tokens that end together."""

    def __init__(self, vocabularies: Pair, texts: list[str | None]):
        self.pair = vocabularies
        found = [vocabularies.ids(t) for t in texts]
        join = lambda side: np.concatenate([np.empty(0, np.int32), *[ids[side] for ids in found]])
        bounds = lambda side: np.cumsum([0, *[len(ids[side]) for ids in found]])
        self.a, self.b, self.first_a, self.first_b = join(0), join(1), bounds(0), bounds(1)
        # Both sides of a text have the same bytes, so that one scale of offsets serves the whole slice.
        ends_a = np.cumsum(vocabularies.a.lengths[self.a])
        ends_b = np.cumsum(vocabularies.b.lengths[self.b])
        self.end_a, self.end_b = self._common(ends_a, ends_b)
        # The groups of each text: bounds among the common ends.
        self.first_group = np.searchsorted(self.end_a, self.first_a, "left")

    def _common(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and B of the offsets in both lists; in each text the shorter list drives."""
        size_a, size_b = np.diff(self.first_a), np.diff(self.first_b)
        a_drives = size_a <= size_b
        of_a, of_b = np.repeat(a_drives, size_a), np.repeat(a_drives, size_b)
        places_a, places_b = np.arange(len(ends_a)), np.arange(len(ends_b))
        # Offsets ascend over the whole slice, so that merging by text is merging by offset.
        short = self._merged(ends_a[of_a], ends_b[~of_b], places_a[of_a], places_b[~of_b])
        long = self._merged(ends_b[of_b], ends_a[~of_a], places_b[of_b], places_a[~of_a])
        if not len(short[0]):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        landed = gallop(short[0], long[0])
        same = long[0][np.minimum(landed, len(long[0]) - 1)] == short[0]
        driver, other, swapped = short[1][same], long[1][landed[same]], short[2][same]
        return np.where(swapped, other, driver), np.where(swapped, driver, other)

    @staticmethod
    def _merged(x: np.ndarray, y: np.ndarray, places_x: np.ndarray, places_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of both in order, the place of each in its side, and whether it is from ``y``."""
        if not len(x) or not len(y):
            return np.concatenate([x, y]), np.concatenate([places_x, places_y]), np.repeat([False, True], [len(x), len(y)])
        offsets = np.concatenate([x, y])
        order = np.argsort(offsets, kind="stable")
        return offsets[order], np.concatenate([places_x, places_y])[order], order >= len(x)

    def links(self) -> np.ndarray:
        """The id pair of each two tokens that end together, as one number."""
        return self.a[self.end_a].astype(np.int64) * self.pair.base + self.b[self.end_b]

    def group_counts(self) -> np.ndarray:
        return np.diff(self.first_group)

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; the empty text where there are no tokens."""
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.end_a], b_last[self.end_b] = True, True
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # A group's tokens of A come behind the groups before, its tokens of B behind those of A.
        at_a = np.arange(len(self.a)) + np.append(0, self.end_b + 1)[group_a]
        at_b = np.arange(len(self.b)) + (self.end_a + 1)[group_b] if len(self.b) else np.empty(0, np.int64)
        width = max(self.pair.a.width, self.pair.b.width)
        signs = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        count = np.zeros(len(signs), np.int64)
        for side, ids, at, last, mark in ((self.pair.a, self.a, at_a, a_last, b"|"), (self.pair.b, self.b, at_b, b_last, b";")):
            signs[at, : side.width] = side.digits[ids]
            count[at] = side.digit_count[ids]
            signs[at, count[at]] = np.where(last, mark[0], b","[0])
        first = self.first_a + self.first_b
        count += 1
        some = np.flatnonzero(np.diff(first))
        final = first[some + 1] - 1
        count[final] -= 1
        signs[final, count[final]] = 0
        text = signs[signs > 0].tobytes()
        ends = np.append(0, np.cumsum(count))[first].tolist()
        return [hashlib.sha256(text[a:b]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:])]

    def group_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For each group where it ends, counted in tokens of its text in A and in B."""
        text = np.repeat(np.arange(len(self.first_group) - 1), np.diff(self.first_group))
        return self.end_a + 1 - self.first_a[text], self.end_b + 1 - self.first_b[text]


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def _key(docs: DataFrame, doc_id: str) -> T.DataType:
    return docs.schema[doc_id].dataType


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends for every row of ``docs``.

    Group k of a text is the tokens of A from ``a_ends[k - 1]`` to ``a_ends[k]`` (exclusive) and
    those of B between the same places of ``b_ends``; both cover the same bytes.  Null and
    empty texts, and texts whose tokens' bytes are not those of a space and the text, have
    empty arrays.  Texts of any length are aligned whole.  Repeated rows each give a row;
    columns besides the two named are ignored.
    """
    names = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = pair(path_a, path_b)
        for part in slices(parts, "text"):
            found = Aligned(vocabularies, part.column("text").to_pylist())
            ends = [x.astype(np.int32) for x in found.group_ends()]
            columns = [_lists(found.first_a, found.a), _lists(found.first_b, found.b), *[_lists(found.first_group, x) for x in ends]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    schema = T.StructType([T.StructField("doc_id", _key(docs, doc_id))])
    for name in names[1:]:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(align, schema)


def _linked(rows: DataFrame, path_a: str, path_b: str, row_pairs: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs and more (whether the next row goes on with the same text)."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "more"]

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = pair(path_a, path_b)
        for part in slices(parts, "text"):
            found = Aligned(vocabularies, part.column("text").to_pylist())
            groups = found.group_counts()
            facts = [part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (np.diff(found.first_a), np.diff(found.first_b), groups)], pa.array(found.digests(), pa.string())]
            pairs, first = found.links(), found.first_group
            if part.num_rows > 1 or groups[0] <= row_pairs:
                yield pa.RecordBatch.from_arrays([*facts, _lists(first, pairs), pa.array(np.zeros(part.num_rows, bool))], names)
                continue
            for start in range(0, len(pairs), row_pairs):
                some = pairs[start : start + row_pairs]
                yield pa.RecordBatch.from_arrays([*facts, _lists(np.array([0, len(some)]), some), pa.array([start + row_pairs < len(pairs)])], names)

    schema = T.StructType([T.StructField("doc_id", _key(rows, "doc_id"))])
    for name in ("n_a", "n_b", "n_groups"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", T.ArrayType(T.LongType())).add("more", "boolean")
    return rows.mapInArrow(align, schema)


def pair_counts(linked: DataFrame, base: int) -> DataFrame:
    """pair, b, n and best of every id pair: how often it is linked, and whether no pair with its id of B is linked oftener."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            every, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([counts, times]), len(every)).astype(np.int64)

        for part in parts:
            waiting.append(part.column("pairs").flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, waiting)) >= HELD_PAIRS:
                keys, counts = merged()
                waiting.clear()
                if len(keys) >= HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    found = linked.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = checkpointed(found.withColumn("b", F.pmod("pair", F.lit(base))))
    # One row for each id of B.
    most = found.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))
    return checkpointed(found.join(most, F.col("b") == F.col("of")).select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def _least_frequent(counts: DataFrame, entries: int) -> int:
    """The smallest power of two that at most ``entries`` pairs are as frequent as."""
    held = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    least, total = 62, 0
    for bits, pairs in sorted(held, reverse=True):
        total += pairs
        if total > entries:
            break
        least = bits - 1
    return 1 << least


def agreement(docs: DataFrame, path_a: str, path_b: str, table_pairs: int = TABLE_PAIRS, row_pairs: int = ROW_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their names.
    ``n_links`` counts the tokens of A and B that end together, ``count_sum`` sums how often their
    id pairs are linked over all rows, and ``n_best`` counts links whose pair is the most
    frequent of its id of B, ties included.  Null and empty texts, and texts whose tokens'
    bytes are not those of a space and the text, have zeros and an empty digest.  Repeated rows
    count as often as they occur.  Texts of any length are taken whole.  An empty table gives
    an empty result.
    """
    base = pair(path_a, path_b).base
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    linked = checkpointed(_linked(rows, path_a, path_b, row_pairs))
    counts = pair_counts(linked, base)
    least = _least_frequent(counts, table_pairs)
    frequent = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    table = tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [*linked.columns[:-2], "n_best", "count_sum", "rest", "row"]

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, best = shared.value
        sums, rest = np.zeros(2, np.int64), []
        for part in parts:
            if not part.num_rows:
                continue
            first = part.column("pairs").offsets.to_numpy()
            pairs = part.column("pairs").values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
            first = first - first[0]
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(known, times[place], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            total = np.append(0, np.cumsum(n))
            top = np.append(0, np.cumsum(best[place] & known if len(keys) else known))
            missing = np.append(0, np.cumsum(~known))
            unknown = pairs[~known]
            more = part.column("more").to_numpy(zero_copy_only=False)
            whole, rests = [], []
            for k in range(part.num_rows) if more.any() or rest else ():
                sums = sums + [top[first[k + 1]] - top[first[k]], total[first[k + 1]] - total[first[k]]]
                rest.append(unknown[missing[first[k]] : missing[first[k + 1]]])
                if not more[k]:
                    whole.append(sums)
                    rests.append(np.concatenate(rest))
                    sums, rest = np.zeros(2, np.int64), []
            if not whole and not rest:
                whole = np.stack([np.diff(top[first]), np.diff(total[first])], axis=1)
                rest_lists = _lists(missing[first], unknown)
            else:
                whole = np.array(whole, np.int64).reshape(-1, 2)
                rest_lists = _lists(np.cumsum([0, *map(len, rests)]), np.concatenate([unknown[:0], *rests]))
            kept = part.select(names[:-4] + ["row"]).filter(pa.array(~more))
            columns = [*[kept.column(c) for c in names[:-4]], pa.array(whole[:, 0]), pa.array(whole[:, 1]), rest_lists, kept.column("row")]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType(linked.schema.fields[:-2]).add("n_best", "long").add("count_sum", "long").add("rest", T.ArrayType(T.LongType())).add("row", "long")
    found = linked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(look_up, schema)
    if least > 1:
        # What the table lacks is rarer than all it holds.
        found = checkpointed(found)
        rare = found.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
        more = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        found = found.join(more, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        )
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
