"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints are computed per document in Arrow batches and collapse to distinct
values with map-side combining.  The index over the distinct values:

* Root nodes are masked bit patterns.  The 64 bits are cut into ``blocks``; two
  codes that differ in at most ``distance`` bits agree on some ``blocks - distance``
  of them, so each choice of that many blocks is one tree whose root nodes are the
  values of the chosen bits.  A pair within the distance meets below a root node of
  at least one tree, and pairs that meet below none are pruned without a comparison.
* Below a root node codes are sorted by Gray rank.  Runs of 16 codes and runs of 16
  such runs are nodes; the bits on which all codes of a node agree are its pattern.
* Nodes are compared with nodes from the top down.  A comparison adds the
  differences in bits that no comparison above has looked at yet; once the sum
  exceeds the distance, the whole pair of groups is pruned.  Groups that are known
  to be one component already are not compared either.

A task emits links that span what it found connected, never all pairs.  Root nodes
with more than ``NODE_LIMIT`` codes are split into parts, and each two parts meet in
a task of their own.  Components of the links are found by large-star and small-star
rounds, which aggregate with map-side combining and are checkpointed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.tables import checkpointed, keep_rows

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4

# Bytes of one text that are split into words at once.
TEXT_BLOCK = 4_000_000
# Codes below a root node that one task compares; more are split into parts.
NODE_LIMIT = 16_384
# Mean codes per root node above which the trees get more, narrower root nodes.
ROOT_LOAD = 2_048
# Codes in a lower node, and lower nodes in an upper node.
FANOUT = 16
# Pairs compared in one numpy step.
STEP = 1 << 21


# Stands for a missing id in keys.
NO_ID = -(2**63)


def text_sha256() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


# Fingerprints


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, lower-cased, in lists; each list begins with the last three words before it."""
    carried, start = [], 0
    while start < len(text):
        end = min(len(text), start + TEXT_BLOCK)
        # A block ends where white space begins, so that no word is cut.
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = carried + text[start:end].lower().split()
        yield words
        carried, start = words[-(SHINGLE_WORDS - 1):], end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in blocks."""
    digest, size = xxhash.xxh64_intdigest, SHINGLE_WORDS
    few: list[bytes] = []
    many = False
    for words in _word_lists(text):
        if len(words) < size:
            few = words
            continue
        many = True
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())]
        yield np.array(found, np.uint64)
    if few and not many:
        yield np.array([digest(b" ".join(few), SEED)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """The 64 bits as a signed number; zero for a text without words."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b""):
        for part in np.split(hashes, range(1 << 16, len(hashes), 1 << 16)):
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    set_bits = np.packbits(2 * counts > total, bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) and text_sha256 for every row of ``docs``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py()) for t in texts]
            columns = [part.column("doc_id"), pa.array(found, pa.int64()), part.column("sha")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_sha256"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_sha256().alias("sha")
    )
    return rows.mapInArrow(batches, "doc_id bigint, fp bigint, text_sha256 string")


# Index


def _bounds(blocks: int) -> list[tuple[int, int]]:
    """Offset and width of each block, of nearly equal widths."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _blocks_for(codes: int, distance: int) -> int:
    """The fewest blocks for which root nodes hold at most ``ROOT_LOAD`` random codes on average."""
    blocks = distance + 1
    while blocks < 64 and codes / 2 ** (64 * (blocks - distance) // blocks) > ROOT_LOAD:
        blocks += 1
    return blocks


def _gray_rank(code: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _node(code: Column, chosen: tuple[tuple[int, int], ...]) -> Column:
    """The bits of the chosen blocks, put together."""
    node, filled = F.lit(0).cast("bigint"), 0
    for offset, width in chosen:
        bits = F.shiftrightunsigned(code, offset).bitwiseAND(F.lit((1 << width) - 1))
        node = node.bitwiseOR(F.shiftleft(bits, filled))
        filled += width
    return node


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): which item (0, 0, 1, 1, 1) and which of its elements (0, 1, 0, 1, 2)."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def _steps(counts: np.ndarray) -> Iterator[slice]:
    """Consecutive slices whose counts sum to about ``STEP``."""
    if len(counts):
        marks = np.searchsorted(np.cumsum(counts), np.arange(STEP, int(counts.sum()) + STEP, STEP), "left") + 1
        cuts = sorted({0, *np.minimum(marks, len(counts)).tolist(), len(counts)})
        yield from (slice(a, b) for a, b in itertools.pairwise(cuts))


class _Level:
    """Nodes over consecutive items; ``first`` has the start of each and the end of the last."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, first: np.ndarray):
        self.first = first
        self.all_set = np.bitwise_and.reduceat(lows, first[:-1])
        self.any_set = np.bitwise_or.reduceat(highs, first[:-1])
        self.mask = ~(self.all_set ^ self.any_set)

    def label(self, labels: np.ndarray) -> np.ndarray:
        """The component of each node, -1 where its items are of several."""
        low = np.minimum.reduceat(labels, self.first[:-1])
        return np.where(low == np.maximum.reduceat(labels, self.first[:-1]), low, -1)


def _cut(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``FANOUT`` items within each group: their bounds, and the bounds of the groups counted in runs."""
    runs = -(-np.diff(first) // FANOUT)
    group, place = _ragged(runs)
    starts = first[:-1][group] + FANOUT * place
    return np.append(starts, first[-1]), np.append(0, np.cumsum(runs))


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def spanning_links(codes: np.ndarray, first: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each code the position of a code of its component, within each group of ``codes``.

    ``codes`` are distinct within a group and sorted by Gray rank there; ``first`` has the
    start of each group and the end of the last.
    """
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance
    broken = np.append(True, ~near | (group[1:] != group[:-1]))
    parent = np.flatnonzero(broken)[np.cumsum(broken) - 1]
    run_first, group_runs = _cut(first)
    top_first, group_tops = _cut(group_runs)
    runs = _Level(codes, codes, run_first)
    tops = _Level(runs.all_set, runs.any_set, top_first)

    # Every two upper nodes of a group, and each with itself.
    top_group = np.repeat(np.arange(len(first) - 1), np.diff(group_tops))
    later = group_tops[top_group + 1] - np.arange(len(top_group))
    for some in _steps(later * FANOUT * FANOUT):
        base = some.start
        a, place = _ragged(later[some])
        a, b = a + base, a + base + place
        common = tops.mask[a] & tops.mask[b]
        apart = np.bitwise_count((tops.all_set[a] ^ tops.all_set[b]) & common)
        one = tops.label(runs.label(parent))
        go = (apart <= distance) & ((one[a] < 0) | (one[a] != one[b]))
        a, b, common, apart = a[go], b[go], common[go], apart[go]
        x, y, pair = _children_of(top_first, a, b)
        seen = common[pair]
        both = runs.mask[x] & runs.mask[y]
        apart = apart[pair] + np.bitwise_count((runs.all_set[x] ^ runs.all_set[y]) & both & ~seen)
        go = apart <= distance
        x, y, both, apart = x[go], y[go], (both | seen)[go], apart[go]
        for few in _steps(np.full(len(x), FANOUT * FANOUT)):
            one = runs.label(parent)
            u, v = x[few], y[few]
            go = (one[u] < 0) | (one[u] != one[v])
            u, v, known, sure = u[go], v[go], both[few][go], apart[few][go]
            i, j, pair = _children_of(run_first, u, v)
            total = sure[pair] + np.bitwise_count((codes[i] ^ codes[j]) & ~known[pair])
            go = (total <= distance) & (parent[i] != parent[j])
            parent = _joined(parent, i[go], j[go])
    return parent


def _children_of(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (child of a, child of b), once each where a is b; and the pair each comes from."""
    wide = first[b + 1] - first[b]
    pair, place = _ragged((first[a + 1] - first[a]) * wide)
    x = first[a][pair] + place // wide[pair]
    y = first[b][pair] + place % wide[pair]
    good = (a[pair] != b[pair]) | (x <= y)
    return x[good], y[good], pair[good]


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (the smallest position of each component) after i and j became linked, pair by pair."""
    if not len(i):
        return parent
    pairs = np.unique(np.stack([np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])]), axis=1)
    root = parent.copy()

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in pairs.T.tolist():
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return _find(root)


def _link_batches(parts: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (tree, node, cell, fp) that are sorted by node and Gray rank."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def links(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        first = np.append(np.flatnonzero(new), len(codes))
        parent = spanning_links(codes, first, distance)
        linked = np.flatnonzero(parent != np.arange(len(codes)))
        pairs = [pa.array(codes[k].view(np.int64)) for k in (linked, parent[linked])]
        return pa.RecordBatch.from_arrays(pairs, ["src", "dst"])

    for part in parts:
        keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "node", "cell")], axis=1)
        held.append((keys, part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        size += part.num_rows
        if size < 1 << 17:
            continue
        keys, codes = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        # Whatever belongs to the last node waits, for more of it may follow.
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield links(keys[:cut], codes[:cut])
        held, size = [(keys[cut:], codes[cut:])], len(codes) - cut
    if size:
        yield links(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def links(codes: DataFrame, distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """src, dst: links that span the components of the distinct fingerprints ``fp``."""
    blocks = _blocks_for(codes.count(), distance)
    chosen = list(itertools.combinations(_bounds(blocks), blocks - distance))
    fp = F.col("fp")
    trees = F.array(*[F.struct(F.lit(k).cast("bigint").alias("tree"), _node(fp, c).alias("node")) for k, c in enumerate(chosen)])
    below = codes.select("fp", _gray_rank(fp).alias("rank"), F.explode(trees).alias("t")).select("fp", "rank", "t.*")
    crowded = below.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / node_limit * 2).alias("parts")).where("parts > 2")
    below = below.join(crowded, ["tree", "node"], "left")
    # Part p of a crowded node meets part q in the cell {p, q}; with two parts or more each pair meets.
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda q: q != part)
    cells = F.transform(other, lambda q: F.least(q, part) * F.col("parts") + F.greatest(q, part))
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cells)
    rows = below.select("tree", "node", F.explode(cells).alias("cell"), "rank", "fp")
    rows = rows.repartition("tree", "node", "cell").sortWithinPartitions("tree", "node", "cell", "rank")
    return rows.select("tree", "node", "cell", "fp").mapInArrow(
        lambda parts: _link_batches(parts, distance), "src bigint, dst bigint"
    )


# Components


def components(edges: DataFrame) -> DataFrame:
    """member, root: for each end of an edge the smallest member of its component (roots not listed)."""

    def minimum(rows: DataFrame) -> DataFrame:
        """Rows (hub, other) with ``low``, the smallest of the hub and all its others.

        The smallest ones are written out, so that both sides of the join are plain tables and the rows of
        a hub with very many others can be split over tasks.
        """
        least = rows.groupBy("hub").agg(F.min("other").alias("low")).select("hub", F.least("hub", "low").alias("low"))
        # Two numbers a row: an eighth of the shuffle's partitions, so that few small files are written.
        few = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
        return rows.join(checkpointed(least.coalesce(few)), "hub")

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("src").alias("hub"), F.col("dst").alias("other")).unionByName(
            pairs.select(F.col("dst").alias("hub"), F.col("src").alias("other"))
        )
        return minimum(both).where(F.col("other") > F.col("hub")).select(F.col("other").alias("src"), F.col("low").alias("dst"))

    def small_star(pairs: DataFrame) -> DataFrame:
        down = pairs.select(F.greatest("src", "dst").alias("hub"), F.least("src", "dst").alias("other"))
        found = minimum(down)
        own = found.select(F.col("hub").alias("src"), F.col("low").alias("dst"))
        return found.select(F.col("other").alias("src"), F.col("low").alias("dst")).unionByName(own)

    def settled(pairs: DataFrame) -> DataFrame:
        return checkpointed(pairs.where(F.col("src") != F.col("dst")).distinct())

    def mark(pairs: DataFrame) -> tuple:
        found = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")))
        return tuple(found.first())

    pairs = settled(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")))
    before = mark(pairs)
    while before[0]:
        pairs = settled(small_star(large_star(pairs)))
        now = mark(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("src").alias("member"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, component, text_sha256.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null and texts
    without words have fingerprint zero and link like any other.  Texts of fewer than
    four words are one shingle.  ``component_id`` is the smallest id in the component,
    null only if no row of it has an id; ``component`` names it also then.  Repeated
    rows share everything.  An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs))
    codes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = components(links(codes, distance))
    members = found.select(F.col("root").alias("member"), "root").distinct().unionByName(found)
    linked = members.join(codes, F.col("fp") == F.col("member")).select("fp", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", F.col("root").alias("component"), "component_id")
    # Written out, so that a fingerprint that very many rows have meets a plain table and its rows can be split over tasks.
    of_code = checkpointed(
        codes.join(named, "fp", "left").select(
            "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least_id").alias("component_id")
        )
    )
    fingerprint_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(of_code, "fp").select("doc_id", fingerprint_hex, "component_id", "component", "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the one with the smallest id.

    Rows without an id come after all others.  Of several rows with that id the one whose
    text has the smallest SHA-256 stays; of rows that repeat text and id, one.
    """
    identity = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    found = checkpointed(near_duplicates(docs))
    firsts = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component", identity.alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("copies"))
    )
    stays = firsts.groupBy("component").agg(F.min("sha").alias("sha"))
    return keep_rows(docs, {"id": identity, "sha": text_sha256()}, checkpointed(firsts.join(stays, ["component", "sha"])))
