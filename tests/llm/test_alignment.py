"""Alignment against dictionaries of ends, with the libraries' own tokens."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from alertloom.llm import alignment
from alertloom.llm.queries import BYTE_LEVEL, PIECES

A = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
SIGNS = alignment._byte_signs()

TEXTS = [
    None, "", " ", "\n", "a", " a  b ", "▁a ▁▁b", "<s>x</s> <unk> <|endoftext|>", "\x00a", "ﬁ ß 𝔘 👍🏽", "a\tb\r\n c", "12,34 (x).[y]\n\n\nz",
    "x" * 3000 + "." * 200 + " " * 1500 + "y", "ü" * 100, "don't we'll I'M", "日本語のテキスト と 한국어", "naïve café ©", " x　y", "a b",
    "é", "the the the and the", "   leading", "trailing   ", "<0x41>",
]


def _texts():
    rng = random.Random(2)
    words = "the of and alignment tokenizer Schönheit über, ungen x1 42 ()".split()
    more = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    noise = ["".join(rng.choice("ab ü\n.1日'") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    return [*TEXTS, *more, *noise, " ".join(rng.choice(words) for _ in range(40_000)), *["a hot text"] * 80]


def _ends(ids, part):
    found, at = [], 0
    for k in ids:
        at += len(part(k))
        found.append(at)
    return found


def _part_a(k):
    return bytes(SIGNS[c] for c in A.id_to_token(k))


def _part_b(k):
    piece = B.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(k) else piece.replace("▁", " ").encode()


def _brute(texts):
    found, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
        if b"".join(map(_part_a, a)) != raw or b"".join(map(_part_b, b)) != raw:
            a, b = [], []
        at_a, at_b = ({e: k for k, e in enumerate(_ends(ids, part))} for ids, part in ((a, _part_a), (b, _part_b)))
        groups, links, x, y = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            groups.append((a[x : at_a[end] + 1], b[y : at_b[end] + 1]))
            links.append((a[at_a[end]], b[at_b[end]]))
            x, y = at_a[end] + 1, at_b[end] + 1
        counts.update(links)
        found.append((a, b, groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for a, b, groups, links in found:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
               hashlib.sha256(told.encode()).hexdigest() if told else "")


def _docs(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return frame.withColumns({c: F.lit("own") for c in ("pair", "row", "n_a", "pairs", "more", "best")})


def test_agreement(spark):
    texts = _texts()
    want = [(k, *x) for k, x in enumerate(_brute(texts))]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for more in ({}, {"table_pairs": 20, "row_pairs": 1000}, {"table_pairs": 0}):
        found = alignment.agreement(_docs(spark, texts), BYTE_LEVEL, PIECES, **more)
        assert sorted(tuple(r[c] for c in names) for r in found.collect()) == want


def test_groups_cover_the_same_bytes(spark):
    texts = _texts()
    for r in alignment.aligned(_docs(spark, texts), BYTE_LEVEL, PIECES).collect():
        parts, x, y = [], 0, 0
        for a, b in zip(r["a_ends"], r["b_ends"]):
            own = b"".join(map(_part_a, r["a_ids"][x:a]))
            assert own and own == b"".join(map(_part_b, r["b_ids"][y:b]))
            parts.append(own)
            x, y = a, b
        assert (x, y) == (len(r["a_ids"]), len(r["b_ids"]))
        assert not parts or b"".join(parts).decode() == " " + texts[r["doc_id"]]


def test_gallop():
    rng = np.random.default_rng(1)
    for size, other in ((0, 5), (1, 1), (5000, 20_000), (20_000, 30_000), (300, 100_000), (50, 3)):
        keys, into = (np.sort(rng.choice(300_000, n, replace=False)) for n in (size, other))
        assert alignment.gallop(keys, into).tolist() == [bisect.bisect_left(into.tolist(), k) for k in keys.tolist()]


def test_fast_encoder_is_the_library():
    pair = alignment.pair(BYTE_LEVEL, PIECES)
    assert pair.byte_level.fast is not None
    for text in filter(None, _texts()):
        assert pair.byte_level.encode(text).tolist() == A.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert alignment.agreement(_docs(spark, []).limit(0), BYTE_LEVEL, PIECES).count() == 0
