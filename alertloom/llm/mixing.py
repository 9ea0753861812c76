"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong
to): one row per pattern comes to the driver.  A flow routes the words of the patterns
to the quotas of the sources.  Each further repetition of a pattern's words costs more
than the one before, so that repetition is spread before it is deepened.  The flow says
how many words each pattern gives: some whole passes over all its documents, and a rest
that is drawn in seeded order.  Draws are rules of the form "size at most g and key at
most t" per pattern, found from sums per key range, so that no pattern is ordered in one
task; applying them is a map.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertloom.llm.tables import checkpointed, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
# The mix takes 150 % of all words, written as a fraction.
TOTAL = (3, 2)
# Most times that a document is taken.
PASSES = 2
SEED = "mix"
# Draws per pattern: each fills what the one before left with documents that still fit; one document more may follow.
ROUNDS = 4
# Patterns that may come to the driver, and sources in all of them.
MAX_PATTERNS = 20_000
# Hex digits of the key that make a range; 65,536 ranges per pattern.
RANGE_DIGITS = 4


def words(text: Column) -> Column:
    """Number of words, null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources are taken by code point, null last, and weighted in turn.  They share
    ``TOTAL`` of all words by weight; a source stops at ``PASSES`` times its size, and what
    that leaves over is shared again among the others.  The result does not depend on
    how often one shares again: sources stop in the order of size by weight, and the rest
    is shared once, by those that never stop.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = [(name, size, weights[k % len(weights)]) for k, (name, size) in enumerate(order)]
    left, weight = TOTAL[0] * sum(r[1] for r in rows), sum(r[2] for r in rows)
    free = sorted(range(len(rows)), key=lambda k: Fraction(rows[k][1], rows[k][2]))
    wanted = {}
    for at, k in enumerate(free):
        name, size, own = rows[k]
        # Its share is own * left / (TOTAL[1] * weight); it stops if that is above its limit.
        if own * left > TOTAL[1] * weight * PASSES * size:
            wanted[name] = float(PASSES * size)
            left, weight = left - TOTAL[1] * PASSES * size, weight - own
        else:
            for j in free[at:]:
                wanted[rows[j][0]] = rows[j][2] * left / (TOTAL[1] * weight)
            break
    return wanted


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def sent(self, arc: tuple[int, int]) -> int:
        own = self.arcs[arc[0]][arc[1]]
        return self.arcs[own.to][own.back].room

    def run(self, start: int, end: int) -> None:
        potential = [0] * len(self.arcs)
        while True:
            far: dict[int, int] = {start: 0}
            via: dict[int, tuple[int, int]] = {}
            queue, done = [(0, start)], set()
            while queue:
                d, a = heapq.heappop(queue)
                if a in done:
                    continue
                done.add(a)
                for k, arc in enumerate(self.arcs[a]):
                    if arc.room <= 0:
                        continue
                    there = d + arc.cost + potential[a] - potential[arc.to]
                    if there < far.get(arc.to, there + 1):
                        far[arc.to], via[arc.to] = there, (a, k)
                        heapq.heappush(queue, (there, arc.to))
            if end not in far:
                return
            for a, d in far.items():
                potential[a] += min(d, far[end])
            for a in range(len(potential)):
                if a not in far:
                    potential[a] += far[end]
            path, a = [], end
            while a != start:
                path.append(via[a])
                a = via[a][0]
            most = min(self.arcs[a][k].room for a, k in path)
            for a, k in path:
                arc = self.arcs[a][k]
                arc.room -= most
                self.arcs[arc.to][arc.back].room += most


def routed(
    patterns: Sequence[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], passes: int = PASSES
) -> list[dict[str | None, int]]:
    """Words that each pattern (its sources, its words) gives each of its sources.

    Pass k over a pattern costs 2k - 1 more per word than none, which makes the cost convex.
    """
    names = list(quotas)
    place = {name: 1 + len(patterns) + k for k, name in enumerate(names)}
    flow, end = Flow(2 + len(patterns) + len(names)), 1 + len(patterns) + len(names)
    given = []
    for p, (members, size) in enumerate(patterns):
        for k in range(passes):
            flow.arc(0, 1 + p, size, 2 * k + 1)
        given.append({s: flow.arc(1 + p, place[s], passes * size, 0) for s in members if s in place})
    for name in names:
        flow.arc(place[name], end, quotas[name], 0)
    flow.run(0, end)
    return [{s: flow.sent(arc) for s, arc in g.items()} for g in given]


def _rules(rows: DataFrame, wanted: dict[int, int], rounds: int) -> list[tuple[int, int, str]]:
    """Rules (pattern, size at most, key at most), in order, that draw ``wanted`` words of each pattern from ``rows``.

    ``rows`` has pattern, size and key.  A rule takes the documents, among those no rule
    before has taken, that fit what is still wanted, in the order of their keys, as long as
    their sum fits too; documents with the same key go together.
    """
    spark, out = rows.sparkSession, []
    gaps = {p: g for p, g in wanted.items() if g > 0}
    for _ in range(rounds):
        if not gaps:
            break
        gap = spark.createDataFrame(list(gaps.items()), "pattern int, gap bigint")
        open_rows = _undrawn(rows, out).join(F.broadcast(gap), "pattern").where((F.col("size") > 0) & (F.col("size") <= F.col("gap")))
        span = F.substring("key", 1, RANGE_DIGITS)
        along = Window.partitionBy("pattern").orderBy("span")
        sums = open_rows.groupBy("pattern", "gap", span.alias("span")).agg(F.sum("size").alias("size"))
        sums = sums.withColumn("before", F.sum("size").over(along) - F.col("size"))
        # The range in which the sum passes what is wanted, or else the last one.
        crossed = sums.where(F.col("before") <= F.col("gap")).groupBy("pattern").agg(
            F.max("span").alias("span"), F.max("before").alias("before")
        )
        inside = open_rows.withColumn("span", span).join(F.broadcast(crossed), ["pattern", "span"])
        reached = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("key"))
        fitting = inside.withColumn("reached", reached).where(F.col("reached") <= F.col("gap"))
        # One row per pattern; without a document of the last range that fits, all ranges before it do.
        last = fitting.groupBy("pattern").agg(F.max("key").alias("key"), F.max("reached").alias("reached"))
        found = crossed.join(last, "pattern", "left").collect()
        taken = {r["pattern"]: (r["key"] or r["span"], r["reached"] if r["key"] else r["before"]) for r in found}
        out += [(p, gaps[p], key) for p, (key, words_taken) in sorted(taken.items()) if words_taken]
        gaps = {p: g - taken.get(p, ("", 0))[1] for p, g in gaps.items()}
        gaps = {p: g for p, g in gaps.items() if g}
    # What is left is below every document that is left; the least one may still bring the sum nearer.
    left = _undrawn(rows, out).where((F.col("size") > 0) & F.col("pattern").isin(list(gaps)))
    least = left.groupBy("pattern").agg(F.min(F.struct("size", "key")).alias("least")).collect() if gaps else []
    out += sorted((r["pattern"], *r["least"]) for r in least if r["least"]["size"] < 2 * gaps[r["pattern"]])
    return out


def _with_rules(rows: DataFrame, rules: list[tuple[int, int, str]]) -> DataFrame:
    """``rows`` with ``rule``: the sizes and keys of its pattern's rules; a broadcast of one row per pattern."""
    by_pattern: dict[int, list[tuple[int, str]]] = {}
    for p, size, key in rules:
        by_pattern.setdefault(p, []).append((size, key))
    table = rows.sparkSession.createDataFrame(
        [(p, ([s for s, _ in r], [k for _, k in r])) for p, r in by_pattern.items()],
        "pattern int, rule struct<sizes: array<bigint>, keys: array<string>>",
    )
    return rows.join(F.broadcast(table), "pattern", "left")


def _undrawn(rows: DataFrame, rules: list[tuple[int, int, str]]) -> DataFrame:
    if not rules:
        return rows
    return _with_rules(rows, rules).where(~_any_rule()).drop("rule")


def _any_rule() -> Column:
    pairs = F.arrays_zip("rule.sizes", "rule.keys")
    fits = F.exists(pairs, lambda r: (F.col("size") <= r["sizes"]) & (F.col("key") <= r["keys"]))
    return F.coalesce((F.col("size") > 0) & fits, F.lit(False))


def mixed(
    docs: DataFrame, sources: Column, weights: Sequence[int] = WEIGHTS, seed: str = SEED, rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, pattern, size, taken, passes, target, source_size.

    ``sources`` is an array with the sources of a document (repeats ignored; a null array
    is the source null).  ``size`` counts words, ``taken`` the words that the mix takes,
    ``passes`` how often it takes the document.  ``target`` and ``source_size`` are of the
    first source in order.  Null and empty texts have no words and are never taken.
    Documents are drawn by md5 of seed and id, so that reruns agree; repeated ids are drawn
    together.  A source's words come within one document of its target as long as documents
    that fit are left.  An empty table gives an empty result.
    """
    members = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = checkpointed(docs.select(F.col("doc_id"), members.alias("members"), words(F.col("text")).alias("size"), key.alias("key")))
    sums = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(r["members"]), r["size"]) for r in sums), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict[str | None, int] = {}
    for names, size in patterns:
        for name in names:
            sizes[name] = sizes.get(name, 0) + size
    wanted = targets(list(sizes.items()), weights)
    quotas = {name: int(t + 0.5) for name, t in wanted.items()}
    given = [sum(g.values()) for g in routed(patterns, quotas)]
    whole = [g // size if size else 0 for g, (_, size) in zip(given, patterns)]
    rest = {p: g - whole[p] * patterns[p][1] for p, g in enumerate(given)}
    plan = rows.sparkSession.createDataFrame(
        [(list(names), p, whole[p], wanted[names[0]], sizes[names[0]]) for p, (names, _) in enumerate(patterns)],
        "members array<string>, pattern int, whole int, target double, source_size bigint",
    )
    planned = _by_pattern(rows, plan)
    drawn = _with_rules(planned, _rules(planned.select("pattern", "size", "key"), rest, rounds))
    passes = F.when(F.col("size") > 0, F.col("whole") + _any_rule().cast("int")).otherwise(0)
    return drawn.select(
        "doc_id", F.col("members").alias("pattern"), "size", "source_size", "target",
        (passes * F.col("size")).cast("bigint").alias("taken"), passes.alias("passes"),
    )


def _by_pattern(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with the plan of its pattern, a broadcast of at most ``MAX_PATTERNS`` rows; arrays with nulls join as text."""
    name = lambda d: F.to_json(F.struct(d["members"]), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("name", name(rows))
    return keyed.join(F.broadcast(plan.withColumn("name", name(plan)).drop("members")), "name").drop("name")


def resampled(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns; ``source`` has the one source of each.

    Rows that share an id and a size share the decision.
    """
    sources, names = F.array(F.col("source").cast("string")), [fresh(docs, n) for n in ("mix_id", "mix_size", "mix_source", "mix_times")]
    found = mixed(docs, sources, seed=seed)
    decided = found.where(F.col("passes") > 0).groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(names[0]), F.col("size").alias(names[1]),
        F.coalesce(F.concat(F.lit("="), F.col("pattern")[0]), F.lit("null")).alias(names[2]),
    ).agg(F.max("passes").alias(names[3]))
    keyed = docs.withColumns({
        names[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), names[1]: words(F.col("text")),
        names[2]: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")),
    })
    again = keyed.join(decided, names[:3]).withColumn(names[3], F.explode(F.sequence(F.lit(1), F.col(names[3]))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
