"""The manifest against trees built level by level in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from alertloom.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([_h(*found[-1][k : k + 2]) for k in range(0, len(found[-1]), 2)])
    return found


def _brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[lang] = _levels([_leaf(r) for r in by_lang[lang]])
    top = _levels([trees[lang][-1][0] for lang in langs])
    for place, lang in enumerate(langs):
        for k, row in enumerate(by_lang[lang]):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            at, siblings = _leaf(row, int(bad)), []
            for tree, p in ((trees[lang], k), (top, place)):
                for level in tree[:-1]:
                    other = level[p ^ 1] if p ^ 1 < len(level) else ""
                    siblings.append(other)
                    at, p = _h(other, at) if p & 1 else _h(at, other), p // 2
            yield row[0], _leaf(row), trees[lang][-1][0], top[-1][0], _h(*siblings), at, at == top[-1][0]


def _rows(sizes):
    rows = [(k * 3 % 1000, f"s{k % 4}", lang, k, f"text {k}") for lang, n in sizes.items() for k in range(n)]
    rows += [(None, None, "en", None, None), (None, None, "en", 4, "x"), (5, "", "", 0, ""), (7, "ü", "é", 2, "ß" * 100_000)]
    # Equal ids of other texts, and rows alike in everything.
    return rows + [(3, "s", "en", 1, "other"), (3, "s", "en", 1, "other"), (3, "s", "en", 1, "another"), *[(14, "a", None, None, "same")] * 9]


@pytest.mark.parametrize(("sizes", "span"), [({"en": 37, None: 16, "zz": 1}, 2), ({"en": 300, "a": 65, "b": 64, "c": 2}, 3), ({"en": 20}, 8)])
def test_manifest(spark, sizes, span):
    rows = _rows(sizes)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("own") for c in ("tree", "leaf", "rank", "n", "lo", "digest", "root")})
    found = merkle.verified(merkle.manifest(docs, span)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(_brute(rows), key=key)
    assert {r["verified"] for r in found} == {True, False}


def test_intervals(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, "t") for k in range(21)] + [(50, "s", "de", 1, "t")], DOCS)
    for r in merkle.manifest(docs, 2).where("lang = 'en'").collect():
        inner, lo, hi = [s for s in r["proof"] if s["level"] < 5][:5], r["rank"], r["rank"]
        for step in inner:
            if step["lo"] is not None:
                assert (step["hi"] == lo - 1) if step["left"] else (step["lo"] == hi + 1)
                lo, hi = min(lo, step["lo"]), max(hi, step["hi"])
            else:
                assert step["digest"] == ""
        assert (lo, hi) == (0, 20)


def test_nodes(spark):
    leaves = [(k, _h(str(k))) for k in range(11)]
    frame = spark.createDataFrame([("t", k, 11, d, None) for k, d in leaves], "tree string, lo bigint, n bigint, digest string, payload string")
    found = {(r["level"], r["lo"], r["hi"]): r["digest"] for r in merkle.Trees(frame, 2).nodes().collect()}
    want = {}
    for level, nodes in enumerate(_levels([d for _, d in leaves])):
        want |= {(level, k << level, min(11, (k + 1) << level) - 1): d for k, d in enumerate(nodes)}
    assert found == want


def test_empty(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0
