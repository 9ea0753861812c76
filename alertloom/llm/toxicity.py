"""Toxicity after noisy-channel deobfuscation.

A token that may be disguised (letters mixed with look-alike signs, single letters set
apart, letters repeated) is a lattice: each observed sign may stand for several letters,
be a separator that stands for nothing, or repeat the letter before.  Viterbi decoding
under a trigram model of characters picks the likeliest letters; they are read as one word
and split at separators.  Where signs between letters stood for letters, and in runs of
letters set apart, the words that are written together are read too: all on paths about as
likely as the best.  Words that stand as they are never give words inside them.  The
restored text is scored by a logistic regression over hashed words and word beginnings.

The character model counts the words of all texts, into hashed tables of a fixed size.  The
regression is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``) chosen by a hash
of the id.  Both are small and broadcast; scoring is a map over whole texts.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import sys
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.language import learnable
from alertloom.llm.tables import Recent, checkpointed, slices

# Rows that the regression is fitted on, about; all if there are fewer.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
# The evidence (G-test) that a feature needs.
LEAST_EVIDENCE = 15.0
# Weight of the penalty on squared coefficients.
PENALTY = 0.01
THRESHOLD = 0.3
# Signs between two shortenings of the decoder's paths.
WINDOW = 64
# Words inside decoded letters count if the best path through them is at most so much less likely (log) than the best.
MARGIN = 4.0
CACHE_TOKENS = 400_000
# Log probabilities that a worker keeps.
KNOWN_GRAMS = 500_000
# Letters from which a word inside decoded letters counts by its beginning alone.
LONGEST = 64
# Places in the hashed tables of three, two and one characters, as powers of two.
TABLE_BITS = (18, 16, 14)
# Lengths of word beginnings that are features besides whole words.
BEGINNINGS = (5, 6, 7)

# Letters that signs are used for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~'/,:"
# Log probabilities of the channel.
PLAIN, LOOK_ALIKE, SKIPPED, REPEATED = 0.0, -1.0, -0.5, -0.5

# Signs that are taken off the ends of a token.
_AROUND = string.punctuation + "«»„“”’…¡¿"
# Of these, signs that do not stand for letters.
_NEVER_LETTERS = "".join(c for c in _AROUND if c not in LOOKS_LIKE)
_LETTER = re.compile(r"[^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# Three or more single signs with blanks between, and maybe other separators; without blanks they are one token.
_SIGN = r"[\w@$!|+(€£¡][.\-_*~'/,:]*"
_SPACED = re.compile(rf"(?<!\S)(?:{_SIGN}\s+){{2,}}{_SIGN}(?!\S)")
# Where a token may be split: at signs that stand for no letter, and at all that are none.
_SPLIT = (re.compile(r"[^\w@$!|+(€£¡]+|_+"), re.compile(r"[\W\d_]+"))


# Look-alike signs between two letters.
_INSIDE = re.compile(rf"[^\W\d_][{re.escape(''.join(LOOKS_LIKE))}]+[^\W\d_]")
# Letters of which none is followed by itself, but for the last.
_STRETCH = re.compile(r"(?:([^\W\d_])(?!\1))*[^\W\d_]?")

_WORD = (1 << 64) - 1
# Multipliers of the hash of characters.
_STEP, _MIX = 0x100000001B3, 0x9E3779B97F4A7C15
# Where each table begins in the counts: three, two and one characters, and two and one before another.
_TABLES = (*TABLE_BITS, *TABLE_BITS[1:])
_STARTS = tuple(sum(1 << b for b in _TABLES[:k]) for k in range(len(_TABLES) + 1))


def _place(table: int, characters: str) -> int:
    """Where a table counts ``characters``."""
    found = 0
    for c in characters:
        found = (found * _STEP + ord(c)) & _WORD
    return _STARTS[table] + (((found * _MIX) & _WORD) >> (64 - _TABLES[table]))


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 1 for white space, 2 for a letter, 4 for a sign taken off a token's ends, else 0."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        kinds[k] = 2 if c.isalpha() else 1 if c.isspace() else 0
    kinds[[ord(c) for c in _AROUND]] = 4
    return kinds


def counted_characters(text: str) -> np.ndarray:
    """The counts of all tables over the words of a lower-case text that, signs at their ends aside, consist of letters."""
    counts = np.zeros(_STARTS[-1], np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    inside = kinds != 1
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1])) if len(codes) else codes
    if not len(starts):
        return counts
    letter, place = kinds == 2, np.arange(len(codes))
    # Characters up to the next token are white space and count for nothing here.
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    others = np.add.reduceat(kinds == 0, starts, dtype=np.int64)
    first = np.minimum.reduceat(np.where(letter, place, len(codes)), starts)
    last = np.maximum.reduceat(np.where(letter, place, -1), starts)
    good = (letters > 0) & (others == 0) & (last - first + 1 == letters)
    sizes = letters[good]
    if not len(sizes):
        return counts
    of_good = np.repeat(good, np.diff(np.append(starts, len(codes))))
    own = codes[starts[0] :][letter[starts[0] :] & of_good]
    # Each word with two marks in front and one behind.
    ends = np.cumsum(sizes + 3)
    padded = np.full(int(ends[-1]), ord("^"), np.uint64)
    padded[np.arange(len(own)) + 3 * np.repeat(np.arange(len(sizes)), sizes) + 2] = own
    padded[ends - 1] = ord("$")
    counted = np.ones(len(padded), bool)
    counted[ends[:-1]] = counted[ends[:-1] + 1] = False
    third = np.flatnonzero(counted[2:]) + 2
    a, b, c = padded[third - 2], padded[third - 1], padded[third]
    step, mix = np.uint64(_STEP), np.uint64(_MIX)
    for table, codes in enumerate(((a * step + b) * step + c, b * step + c, c, a * step + b, b)):
        found = ((codes * mix) >> np.uint64(64 - _TABLES[table])).astype(np.int64)
        counts[_STARTS[table] : _STARTS[table + 1]] = np.bincount(found, minlength=1 << _TABLES[table])
    return counts


class Characters:
    """A trigram model of characters: interpolated with bigrams and single characters; counts are in hashed tables."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.total = int(counts[_STARTS[2] : _STARTS[3]].sum()) + 1

    @functools.cached_property
    def known(self) -> dict[str, float]:
        return {}

    def log(self, before: str, letter: str) -> float:
        gram = before + letter
        found = self.known.get(gram)
        if found is None:
            at = lambda table, characters: int(self.counts[_place(table, characters)])
            one = (at(2, letter) + 0.1) / self.total
            two = at(1, gram[1:]) / max(1, at(4, gram[1:2]))
            three = at(0, gram) / max(1, at(3, gram[:2]))
            if len(self.known) >= KNOWN_GRAMS:
                self.known.clear()
            # Tables that share places may count more of a part than of the whole.
            found = self.known[gram] = math.log(min(1.0, 0.6 * min(1.0, three) + 0.3 * min(1.0, two) + 0.1 * one))
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def decoded(self, signs: str) -> str:
        """The likeliest letters for ``signs``; the state is the last two letters, ^ marks the start and $ the end."""
        paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        done: list[str] = []
        place = 0
        while place < len(signs):
            sign = signs[place]
            if len(paths) == 1:
                # What there is one path to can be put aside; letters that repeat none before stand for themselves.
                ((state, (_, text)),) = paths.items()
                run = _STRETCH.match(signs, place).group() if sign != state[1] else ""
                done.append(text + run)
                paths = {(state + run)[-2:]: (0.0, "")}
                if run:
                    place += len(run)
                    continue
            place += 1
            after: dict[str, tuple[float, str]] = {}
            letters = [(sign, PLAIN)] if _LETTER.match(sign) else [(c, LOOK_ALIKE) for c in LOOKS_LIKE.get(sign, "")]
            for state, (score, text) in paths.items():
                steps = [(state[1] + c, score + cost + self.log(state, c), text + c) for c, cost in letters]
                if sign in SEPARATORS or not letters:
                    steps.append((state, score + SKIPPED, text))
                if any(c == state[1] for c, _ in letters):
                    steps.append((state, score + REPEATED, text))
                for new, total, found in steps:
                    if new not in after or total > after[new][0]:
                        after[new] = (total, found)
            paths = after
            if len(max(paths.values(), key=lambda p: len(p[1]))[1]) > WINDOW:
                # What all paths agree on is put aside, so that long input takes linear time.
                done.append(os.path.commonprefix([text for _, text in paths.values()]))
                paths = {state: (score, text[len(done[-1]):]) for state, (score, text) in paths.items()}
        return "".join(done) + max((score + self.log(state, "$"), text) for state, (score, text) in paths.items())[1]

    def words(self, letters: str, margin: float = MARGIN) -> tuple[list[str], Iterator[str]]:
        """The likeliest words that ``letters`` are written together from, and those on paths at most ``margin`` less likely.

        A word of two letters or more from i to j scores ``head[i] + tail[j]``, so that the best start
        of a word that ends at j is a running maximum and time is linear.
        """
        n = len(letters)
        if not n:
            return [], iter(())
        sums = [0.0, 0.0, 0.0]
        for k in range(2, n):
            sums.append(sums[-1] + self.log(letters[k - 2 : k], letters[k]))
        one = [self.log("^^", c) for c in letters]
        alone = [one[k] + self.log("^" + c, "$") for k, c in enumerate(letters)]
        head = [one[k] + self.log("^" + letters[k], letters[k + 1]) - sums[k + 2] for k in range(n - 1)]
        tail = [0.0, 0.0, *(sums[j] + self.log(letters[j - 2 : j], "$") for j in range(2, n + 1))]

        ahead, start = [0.0] * (n + 1), [0] * (n + 1)
        top, at = -math.inf, 0
        for j in range(1, n + 1):
            if j > 1 and ahead[j - 2] + head[j - 2] > top:
                top, at = ahead[j - 2] + head[j - 2], j - 2
            ahead[j], start[j] = max((ahead[j - 1] + alone[j - 1], j - 1), (top + tail[j], at))
        back, top = [0.0] * (n + 1), -math.inf
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                top = max(top, tail[i + 2] + back[i + 2])
            back[i] = max(alone[i] + back[i + 1], head[i] + top) if i < n - 1 else alone[i] + back[i + 1]
        best, j = [], n
        while j:
            best.append(letters[start[j] : j])
            j = start[j]
        return best[::-1], self._near(letters, ahead, back, alone, head, tail, ahead[n] - margin)

    @staticmethod
    def _near(letters: str, ahead: list, back: list, alone: list, head: list, tail: list, least: float) -> Iterator[str]:
        """All words on paths that score ``least`` or more; of one over ``LONGEST`` letters the beginning, with a mark that it goes on."""
        n = len(letters)
        yield from (letters[k] for k in range(n) if ahead[k] + alone[k] + back[k + 1] >= least)
        if n < 2:
            return
        left, right = np.array(ahead[: n - 1]) + head, np.array(tail) + back
        beyond = np.append(np.maximum.accumulate(right[::-1])[::-1], np.full(LONGEST, -np.inf))
        for i in np.flatnonzero(left + beyond[2 : n + 1] >= least).tolist():
            wanted, last = least - left[i], i + LONGEST
            for j in (np.flatnonzero(right[i + 2 : last + 1] >= wanted) + i + 2).tolist():
                yield letters[i:j]
            if beyond[last + 1] >= wanted:
                yield letters[i:last] + "…"


def suspicious(token: str) -> bool:
    """Whether a lower-case token without signs at its edges may be disguised."""
    if not _LETTER.search(token):
        return False
    return not token.isalpha() and any(c in LOOKS_LIKE or c in SEPARATORS for c in token) or bool(_TRIPLE.search(token))


def _restored(token: str, characters: Characters | None) -> str:
    """A lower-case token without signs at its ends, decoded if it may be disguised."""
    if token.isalpha() and not _TRIPLE.search(token):
        return token
    if characters is not None:
        for form in (token.strip(_NEVER_LETTERS), token.strip(_AROUND)):
            if suspicious(form):
                return characters.decoded(form)
    return token.strip(_AROUND)


def _readings(token: str, characters: Characters | None) -> Iterator[str]:
    """The words that a lower-case token may stand for: joined, split at signs, and written together with signs for letters."""
    core = token.strip(_NEVER_LETTERS)
    if core.isalpha() and not _TRIPLE.search(core):
        yield core
        return
    whole = _restored(token, characters)
    yield whole
    if token.isalpha():
        return
    if characters is not None:
        # Signs at one end may stand for letters while those at the other are punctuation.
        yield from (characters.decoded(f) for f in {core.rstrip(_AROUND), core.lstrip(_AROUND)} - {core} if suspicious(f))
    single = True
    for split in _SPLIT:
        parts = [p for p in split.split(token) if p]
        single = single and max(map(len, parts), default=0) == 1 and len(parts) > 2
        for p in parts:
            if len(p) > 1 and p != token:
                yield _restored(p, characters)
    # Words inside other letters are read only if a sign between letters stood for one, or all letters are set apart.
    if characters is not None and whole.isalpha() and (single or _INSIDE.search(token)):
        yield from characters.words(whole)[1]


def _runs(low: str, characters: Characters | None) -> Iterator[tuple[list[str], Iterator[str]]]:
    """Of each run of letters with blanks between: its likeliest words; and all words it may stand for, joined, split at wide gaps and inside."""
    for run in _SPACED.findall(low) if characters is not None else ():
        if _LETTER.search(run):
            whole = characters.decoded(" ".join(run.split()))
            best, inside = characters.words(whole)
            wide = (characters.decoded(" ".join(p.split())) for p in re.split(r"\s{2,}", run))
            yield best, itertools.chain([whole], wide, inside)


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    if not word:
        return []
    digest, size = xxhash.xxh32_intdigest, len(word)
    return [digest("=" + word) % BUCKETS, *[digest(f"{n}{word[:n]}") % BUCKETS for n in BEGINNINGS if size >= n]]


@dataclass
class Model:
    characters: Characters | None
    weights: dict[int, float]
    bias: float
    # Features that no clean row of the sample has; having any of them is a feature too.
    pure: frozenset[int] = frozenset()

    def score(self, found: set[int]) -> float:
        found = _marked(found, self.pure)
        # Added in a fixed order, so that reruns agree to the last bit.
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[k] for k in sorted(found))))))


# The feature of having a feature that no clean row has.
ANY_PURE = BUCKETS


def _marked(found: set[int], pure: frozenset[int]) -> set[int]:
    return found if pure.isdisjoint(found) else found | {ANY_PURE}


class _Reader:
    """Which features of interest a text has; keeps what it has found for tokens."""

    def __init__(self, characters: Characters | None, wanted: set[int] | None):
        self.characters, self.wanted = characters, wanted
        self.found = Recent(self._of, CACHE_TOKENS)

    def _of(self, token: str) -> tuple[int, ...]:
        wanted, own = self.wanted, []
        for word in _readings(token, self.characters):
            found = features(word)
            own += found if wanted is None else [k for k in found if k in wanted]
        return tuple(dict.fromkeys(own))

    def __call__(self, text: str) -> set[int]:
        seen: set[int] = set()
        found, low = self.found, text.lower()
        for token in set(low.split()):
            own = found[token]
            if own:
                seen.update(own)
        for _, words in _runs(low, self.characters):
            seen.update(k for w in words for k in features(w) if self.wanted is None or k in self.wanted)
        return seen


_READERS: dict[str, _Reader] = {}


def _reader(name: str, characters: Characters | None, wanted: set[int] | None) -> _Reader:
    """The worker's reader of that name, kept from task to task; one at a time."""
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = _Reader(characters, wanted)
    return _READERS[name]


def _drawn(known: DataFrame, limit: int) -> Column:
    """Whether a row's id is among the about ``limit`` that are drawn from ``known``; the same for both sides of a join."""
    share = min(1.0, limit / max(1, known.count()))
    return F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))


def character_model(texts: DataFrame) -> Characters:
    """A model of the words of ``texts`` that consist of letters; all their trigrams are counted, of any script."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_STARTS[-1], np.int64)
        for part in slices(parts, "text"):
            counts += counted_characters(" ".join(t or "" for t in part.column("text").to_pylist()).lower())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["place", "n"])

    # As many rows as the tables have places at most.
    counted = texts.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_STARTS[-1], np.int64)
    counts[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    return Characters(counts)


def _chosen(toxic: np.ndarray, clean: np.ndarray, toxic_rows: int, clean_rows: int) -> list[int]:
    """Buckets that are more frequent in toxic rows, by the G-test."""
    seen = toxic + clean
    share = toxic_rows / max(1, toxic_rows + clean_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (
            np.where(toxic > 0, toxic * np.log(toxic / (seen * share)), 0)
            + np.where(clean > 0, clean * np.log(clean / (seen * (1 - share))), 0)
        )
    good = (toxic > seen * share) & (g >= LEAST_EVIDENCE) & (toxic >= 2)
    best = np.flatnonzero(good)
    return best[np.lexsort((best, -g[best]))].tolist()


def _solved(times, slope: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The solution of ``times(x) = slope`` for a positive definite product, by conjugate gradients scaled by its diagonal."""
    found = np.zeros_like(slope)
    rest = slope.copy()
    eased = rest / scale
    way, size = eased.copy(), rest @ eased
    for _ in range(len(slope) + 10):
        if size <= 1e-24 * max(1.0, slope @ slope):
            break
        moved = times(way)
        step = size / (way @ moved)
        found += step * way
        rest -= step * moved
        eased = rest / scale
        way, size = eased + (rest @ eased) / size * way, rest @ eased
    return found


def _fitted(rows: list[tuple[int, list[int]]], chosen: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients and bias of a logistic regression with a squared penalty, by Newton's method on sparse rows."""
    place = {k: n for n, k in enumerate(chosen)}
    size = len(chosen) + 1
    row = np.repeat(np.arange(len(rows)), [len(found) + 1 for _, found in rows])
    column = np.array([n for _, found in rows for n in (*(place[k] for k in found), size - 1)], np.int64)
    y = np.array([label for label, _ in rows], float)
    across = lambda w: np.bincount(row, w[column], len(rows))
    down = lambda v: np.bincount(column, v[row], size)
    penalty = np.append(np.full(len(chosen), PENALTY), 1e-6)
    w = np.zeros(size)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(across(w), -30, 30)))
        spread = p * (1 - p)
        slope = down(p - y) + penalty * w
        curve = lambda x: down(spread * across(x)) + (penalty + 1e-9) * x  # noqa: B023, E731
        step = _solved(curve, slope, down(spread) + penalty + 1e-9)
        # Steps are shortened so that separable data does not make them run away.
        w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows that may be learned from.

    Rows whose label is null, and ids that are labelled both ways, teach nothing.  Without a
    toxic or without a clean row the model scores everything alike, by the share of toxic rows.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")
    )
    known = known.where(F.col("toxic") == F.col("other")).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Drawn on both sides before they meet, so that the texts of all other rows do not shuffle; read once.
    drawn = _drawn(known, limit)
    sample = checkpointed(texts.where(drawn).join(known.where(drawn), "doc_id").select("toxic", "text"))
    characters = character_model(texts)
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    name = uuid.uuid4().hex

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts, rows = _reader(f"all {name}", shared.value, None), np.zeros((2, BUCKETS), np.int64), [0, 0]
        for part in slices(parts, "text"):
            for label, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                counts[label, list(reader(text))] += 1
                rows[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        # The bucket after the last has the number of rows.
        columns = [np.append(used, BUCKETS), np.append(counts[1, used], rows[1]), np.append(counts[0, used], rows[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "toxic", "clean"])

    counted = sample.mapInArrow(count, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).toPandas()
    counts = np.zeros((2, BUCKETS + 1))
    counts[0, counted["bucket"].to_numpy(np.int64)], counts[1, counted["bucket"].to_numpy(np.int64)] = counted["toxic"], counted["clean"]
    toxic_rows, clean_rows = int(counts[0, -1]), int(counts[1, -1])
    chosen = _chosen(counts[0, :-1], counts[1, :-1], toxic_rows, clean_rows)
    if not chosen or not clean_rows:
        share = (toxic_rows + 0.5) / (toxic_rows + clean_rows + 1)
        return Model(characters, {}, math.log(share / (1 - share)))
    wanted = set(chosen)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(f"chosen {name}", shared.value, wanted)
        for part in slices(parts, "text"):
            found = [sorted(reader(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    pure = frozenset(k for k in chosen if not counts[1, k])
    read_rows = sample.mapInArrow(read, "toxic int, found array<int>").collect()
    rows = sorted((r["toxic"], sorted(_marked(set(r["found"]), pure))) for r in read_rows)
    weights, bias = _fitted(rows, [*chosen, ANY_PURE])
    return Model(characters, dict(zip([*chosen, ANY_PURE], weights.tolist())), bias, pure)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches ``threshold``) of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; only the text decides, and other columns are ignored.
    Null and empty texts get the score of a text without toxic words.  Repeated rows each
    give a row.  Texts and tokens of any length are read whole, in linear time.  An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    name = uuid.uuid4().hex

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = _reader(f"score {name}", own.characters, set(own.weights))
        for part in slices(parts, "text"):
            found = [own.score(reader(t or "")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``restored``: the words of each text after deobfuscation, joined by blanks; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model.characters)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def words(text: str, characters: Characters) -> str:
        low = text.lower()
        return " ".join([*(w for t in low.split() for w in apart(t, characters)), *(w for best, _ in _runs(low, characters) for w in best)])

    def apart(token: str, characters: Characters) -> list[str]:
        parts = [p for p in _SPLIT[0].split(token) if p]
        # Single signs are one word that is set apart.
        return [_restored(p, characters) for p in parts] if parts and min(map(len, parts)) > 1 else [_restored(token, characters)]

    def restore(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, "text"):
            found = [words(t or "", shared.value) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "restored"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(restore, f"doc_id {kind}, restored string")
