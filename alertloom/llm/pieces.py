"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by the
piece's score and then by position, and merges the best pair until the agenda is
empty; symbols outside the vocabulary become byte pieces.  A text is encoded in
segments: between two characters that stand next to each other inside no piece, no
merge can reach across, so that segments encode alone.

The distinct segments of an Arrow slice that a worker has not seen of late are encoded
together: their symbols and the ranks of their adjacent pairs are rows of two matrices,
and each round merges the best pair of every row.  Segments over ``LONG_SEGMENT`` signs
have an agenda of their own, a heap.  Encoded segments stay in a cache that is bounded
in bytes.  In each Arrow slice the ids of all whole texts are checked against the
sentencepiece library in one call.

Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.tables import slices

# Bytes of encoded segments that a worker keeps, about; beyond, only what the last slice used stays.
CACHE_BYTES = 40_000_000
# What an entry takes besides its key and its ids, and the longest key that is kept, in characters.
ENTRY_BYTES, LONGEST_KEPT = 160, 256
SPACE = "▁"
# Longest segment with a row in the matrices; longer ones are cut where the vocabulary allows.
LONG_SEGMENT = 64
# Widths of the matrices; segments are padded to the next one.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64)
# Symbols above all that stand for signs in pieces: one for each code point, and one that pads.
_CODE_POINTS = 0x110000


class Agendas:
    """The agendas of many segments at once, as rows of matrices.

    Symbols are numbers: pieces and the single signs that occur in pieces first, then any code
    point outside them.  ``rank`` finds in a hash table which piece two symbols form.
    """

    def __init__(self, ranks: dict[str, int], ids: dict[str, int], byte_ids: list[int]):
        names = list(dict.fromkeys([*ranks, *[c for piece in ranks for c in piece]]))
        number = {name: k for k, name in enumerate(names)}
        self.base = len(names)
        self.width = self.base + _CODE_POINTS + 1
        self.pad = self.width - 1
        self.none = len(ranks)
        self.of_rank = np.zeros(len(ranks) + 1, np.int64)
        keys, values = [], []
        for piece, rank in ranks.items():
            self.of_rank[rank] = number[piece]
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int64))
        self.of_sign = np.arange(self.base, self.base + _CODE_POINTS, dtype=np.int64)
        for name, k in number.items():
            if len(name) == 1:
                self.of_sign[ord(name)] = k
        # Ids of the symbols that have one; -1 stands for byte pieces.
        self.id_of = np.full(self.base, -1, np.int32)
        self.id_of[[number[name] for name in ids]] = list(ids.values())
        self.signs = [name if len(name) == 1 else "" for name in names]
        self.byte_ids = np.array(byte_ids, np.int32)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table, a quarter full at most; a key that meets another goes on to the next place."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, self.none, np.int64)
        places, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[places[left]] < 0]
            self.keys[places[free]], self.values[places[free]] = keys[free], values[free]
            left = left[self.keys[places[left]] != keys[left]]
            places[left] = (places[left] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each two symbols form, ``none`` where there is none."""
        keys = left * self.width + right
        place = self._place(keys)
        held = self.keys[place]
        found = np.where(held == keys, self.values[place], self.none)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[place[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def _merged(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and their symbols, as rows come to their end."""
        rows, count = np.arange(len(symbols)), symbols.shape[1]
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), count - 1)
        while len(rows) and count > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == self.none
            if over.any():
                yield rows[over], symbols[over]
                keep = ~over
                rows, symbols, ranks, at, best = rows[keep], symbols[keep], ranks[keep], at[keep], best[keep]
            every = np.arange(len(rows))
            symbols[every, at] = self.of_rank[best]
            stays = np.ones(symbols.shape, bool)
            stays[every, at + 1] = False
            symbols = symbols[stays].reshape(len(rows), count - 1)
            stays = np.ones(ranks.shape, bool)
            stays[every, at] = False
            ranks = ranks[stays].reshape(len(rows), count - 2)
            count -= 1
            for first in (at - 1, at):
                some = np.flatnonzero((first >= 0) & (first < count - 1))
                place = first[some]
                ranks[some, place] = self.rank(symbols[some, place], symbols[some, place + 1])
        if len(rows):
            yield rows, symbols

    def __call__(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, packed; blanks are written as in pieces, none is longer than ``LONG_SEGMENT``."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        signs = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        every = np.append(self.of_sign[signs], self.pad)
        start = np.cumsum(size) - size
        width_of = np.searchsorted(WIDTHS, size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k, width in enumerate(WIDTHS):
            own = np.flatnonzero(width_of == k)
            if len(own):
                place = start[own, None] + np.arange(width)
                place[np.arange(width) >= size[own, None]] = len(signs)
                done += [(own[rows], symbols) for rows, symbols in self._merged(every[place])]
        count = np.zeros(len(segments), np.int64)
        for rows, symbols in done:
            count[rows] = (symbols != self.pad).sum(axis=1)
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for rows, symbols in done:
            real = symbols != self.pad
            # Pads stand behind all others, for they join with none.
            flat[((ends - count)[rows, None] + np.arange(symbols.shape[1]))[real]] = symbols[real]
        ids, ends = self._ids(flat, ends)
        whole, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def _ids(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, with byte pieces for those that have none; and where the first ``ends`` symbols end then."""
        ids = np.where(symbols < self.base, self.id_of[np.minimum(symbols, self.base - 1)], -1).astype(np.int32)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, ends
        sign = lambda s: self.signs[s] if s < self.base else chr(s - self.base)
        raw = [sign(s).encode("utf-8", "surrogatepass") for s in symbols[odd].tolist()]
        count = np.ones(len(ids), np.int64)
        count[odd] = list(map(len, raw))
        first = np.append(0, np.cumsum(count))
        found = np.repeat(ids, count)
        found[found < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return found, first[ends]


class Vocabulary:
    """A vocabulary file, read through the library: pieces, scores, byte pieces, and where texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        library = self.library
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(k) for k in range(size)]
        special = [library.is_control(k) or library.is_unknown(k) for k in range(size)]
        self.byte_ids = [0] * 256
        for k in range(size):
            if library.is_byte(k):
                self.byte_ids[int(self.pieces[k][3:5], 16)] = k
                special[k] = True
        self.ids = {p: k for k, p in enumerate(self.pieces) if not special[k] and not library.is_unused(k)}
        # Rank 0 is the piece that merges first.
        order = sorted(self.ids.values(), key=lambda k: (-library.get_score(k), k))
        rank = {k: r for r, k in enumerate(order)}
        self.rank = {p: rank[k] for p, k in self.ids.items()}
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.segment = self._segments()
        self.agendas = Agendas(self.rank, self.ids, self.byte_ids)
        joined = set("".join(self.inside))
        self.apart = next(c for c in map(chr, range(1, 128)) if c not in joined)
        self.apart_size = len(self.library.encode(self.apart))
        self._tables()

    def _segments(self) -> re.Pattern:
        """What texts are cut into, at places where no piece spans the two neighbours.

        A segment is a run of blanks and line breaks with what follows it.
        """
        if any(pair[1] in (SPACE, "\n") and pair[0] != pair[1] for pair in self.inside):
            raise ValueError("a piece holds a blank or line break after another character")
        return re.compile(r"[ \n]+[^ \n]*")

    def segments(self, text: str) -> list[str]:
        """The segments of a text with the blank that the library puts first; none of an empty text."""
        return self.segment.findall(" " + text.replace(SPACE, " ")) if text else []

    def _tables(self) -> None:
        parts = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, k in enumerate(self.byte_ids):
            parts[k] = bytes([byte])
        for k in range(len(parts)):
            if self.library.is_control(k):
                parts[k] = b""
            elif self.library.is_unknown(k):
                parts[k] = " ⁇ ".encode()
        self.parts = parts

    def merged(self, text: str) -> list[int]:
        """Ids of ``text``, whose blanks are written as in pieces; by an agenda of its own."""
        symbols = self._heap(text)
        ids, out = self.ids, []
        for symbol in symbols:
            found = ids.get(symbol)
            if found is not None:
                out.append(found)
            else:
                out.extend([self.byte_ids[byte] for byte in symbol.encode("utf-8", "surrogatepass")])
        return out

    def _heap(self, text: str) -> list[str]:
        """The symbols that are left; the agenda is a heap of (rank, start of a symbol, start of the next)."""
        size, rank = len(text), self.rank
        agenda = [(found, k, k + 1) for k in range(size - 1) if (found := rank.get(text[k : k + 2])) is not None]
        heapq.heapify(agenda)
        # The end of each symbol, -1 once it is part of another; and the start of the symbol before.
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while agenda:
            found, a, b = heapq.heappop(agenda)
            # Stale if one side is gone or has grown since.
            if end[a] != b or end[b] < 0 or rank.get(text[a : end[b]]) != found:
                continue
            end[a], end[b] = end[b], -1
            right, left = end[a], before[a]
            if right < size:
                before[right] = a
                if (joined := rank.get(text[a : end[right]])) is not None:
                    heapq.heappush(agenda, (joined, a, right))
            if left >= 0 and (joined := rank.get(text[left : end[a]])) is not None:
                heapq.heappush(agenda, (joined, left, a))
        starts = [k for k in range(size) if end[k] > 0]
        return [text[k : end[k]] for k in starts]

    def encoded(self, keys: list[str]) -> list[bytes]:
        """Packed ids of the segment of each key; a long one is cut wherever no piece spans two neighbours."""
        segments = [SPACE + k if k[:1] not in "\n\0" else self.named(k).replace(" ", SPACE) for k in keys]
        long = [k for k, n in enumerate(map(len, segments)) if n > LONG_SEGMENT]
        if not long:
            return self.agendas(segments)
        inside, parts, first = self.inside, [], [0]
        for k in long:
            text, segments[k] = segments[k], ""
            cuts = [0, *[c for c in range(1, len(text)) if text[c - 1 : c + 1] not in inside], len(text)]
            parts += [text[a:b] for a, b in itertools.pairwise(cuts)]
            first.append(len(parts))
        found = self.agendas(segments + [p if len(p) <= LONG_SEGMENT else "" for p in parts])
        found, cut = found[: len(segments)], found[len(segments) :]
        for k, (a, b) in zip(long, itertools.pairwise(first)):
            found[k] = b"".join(f if len(p) <= LONG_SEGMENT else np.array(self.merged(p), np.int32).tobytes() for f, p in zip(cut[a:b], parts[a:b]))
        return found

    def keys(self, text: str) -> list[str]:
        """The segments of a text by shorter names: a segment of one blank and a word goes without the blank.

        Where the text has neither two blanks nor two line breaks in a row, each of them begins a segment.
        """
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        if "  " not in text and "\n\n" not in text:
            return text.replace("\n", " \n").split(" ")[1:]
        return [s[1:] if s[0] == " " and s[1:2] not in ("", " ", "\n") else "\0" + s if s[0] == " " else s for s in self.segment.findall(text)]

    @staticmethod
    def named(key: str) -> str:
        """The segment of a key; only keys from the slow path hold blanks."""
        return key[1:] if key[:2] == "\0 " else key if key[:1] == "\n" else " " + key

    def decoded(self, ids: list[int]) -> str:
        """The text of ``ids``; of its blanks the one that encoding put first goes again."""
        return b"".join(map(self.parts.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker and path."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts and keeps the segments it has seen, as packed ids."""

    def __init__(self, words: Vocabulary, check: bool, cache_bytes: int = CACHE_BYTES):
        self.words, self.check, self.cache_bytes = words, check, cache_bytes
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, keys: set[str]) -> list[str]:
        """Puts all of ``keys`` into the cache; those that were not there."""
        new = list(keys.difference(self.cache))
        found = self.words.encoded(new)
        self.cache.update(zip(new, found))
        self.held += sum(map(len, new)) + sum(map(len, found)) + ENTRY_BYTES * len(new)
        return new

    def _forget(self, used: set[str], new: list[str]) -> None:
        """Drops long keys; and over the limit all that the last slice did not use, or everything if that is too much."""
        for key in [k for k in new if len(k) > LONGEST_KEPT]:
            self.held -= len(key) + len(self.cache.pop(key)) + ENTRY_BYTES
            used.discard(key)
        if self.held > self.cache_bytes:
            self.cache = {k: self.cache[k] for k in used}
            self.held = sum(map(len, used)) + sum(map(len, self.cache.values())) + ENTRY_BYTES * len(used)
            if self.held > self.cache_bytes:
                self.cache, self.held = {}, 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, all checked in one call of the library."""
        keys = list(map(self.words.keys, texts))
        used = set().union(*keys)
        new = self._learn(used)
        get = self.cache.__getitem__
        found = [np.frombuffer(b"".join(map(get, own)), np.int32) for own in keys]
        self._forget(used, new)
        if self.check:
            for text, ids, theirs in zip(texts, found, self.words.library.encode(texts, num_threads=1)):
                if ids.tolist() != theirs:
                    raise ValueError(f"{text[:200]!r}: ids differ from the library's")
        return found


@functools.cache
def _encoder(path: str, check: bool) -> Encoder:
    return Encoder(vocabulary(path), check)


def encoded(docs: DataFrame, path: str, text: str = "text", check: bool = True, decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) added, and ``decoded`` (the text of those ids) if asked for.

    Ids are the library's for the whole text, without begin or end.  Null and empty texts
    have no ids and decode to the empty text.  Special strings in a text are ordinary text.
    Columns of ``docs`` named ``ids`` or ``decoded`` are replaced; all others stay, in order.
    With ``check`` every whole text is compared with the library's ids, and the job fails at
    a difference.  Texts of any length are encoded whole; repeated rows each give a row.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields]).add("ids", T.ArrayType(T.IntegerType()))
    if decode:
        schema = schema.add("decoded", "string")
    names = schema.fieldNames()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, check)
        for part in slices(parts, text):
            found = encoder([t or "" for t in part.column(text).to_pylist()])
            first = np.cumsum([0, *map(len, found)])
            ids = np.concatenate([np.empty(0, np.int32), *found])
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))]
            if decode:
                texts = [encoder.words.decoded(ids.tolist()) for ids in found]
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(encode, schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` added: the text of the array ``ids``, as the library decodes it; null ids are none."""
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields]).add("decoded", "string")
    names = schema.fieldNames()

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in parts:
            texts = [words.decoded(found or []) for found in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(decode, schema)
