"""Near duplicates of vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import embedding_dups


def _brute(rows, threshold=0.93):
    good = []
    for k, (_, vector, label) in enumerate(rows):
        fine = label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        good.append(fine)
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    least, found = {}, []
    for k in range(len(rows)):
        seen, open_ = {k}, [k]
        while open_:
            new = links[open_.pop()] - seen
            seen |= new
            open_ += new
        least[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        found.append((rows[k][0], len(links[k]), least[k], rows[k][0] == least[k]))
    return found


def _rows():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, 2):
        base = rng.normal(size=(12, 16))
        for k in range(240):
            rows.append((len(rows) * 7 % 10_007, (base[k % 12] + 0.25 * rng.normal(size=16)).tolist(), label))
    # A third of the rows lie within one narrow cone, another group is one vector.
    center = rng.normal(size=16)
    rows += [(20_000 + k, (center + 0.03 * rng.normal(size=16)).tolist(), 1) for k in range(300)]
    rows += [(30_000 + k, rows[3][1], 0) for k in range(60)] + [rows[5], rows[5]]
    rows += [(30_000, rows[3][1], 2), (40_000, [x * 1e300 for x in rows[9][1]], 0), (40_001, [x * 1e-300 for x in rows[9][1]], 0)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0], [2.0], [1.0] * 16]
    rows += [(50_000 + k, v, 0) for k, v in enumerate(odd)] + [(60_000, [1.0] * 16, None), (60_001, [1.0] * 16, None)]
    return rows + [(None, [1.0] * 16, 0), (None, [1.0, 5.0], 9), (None, rows[3][1], 0)]


def _frame(spark, rows, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(4)
    return frame.withColumns({c: F.lit("own") for c in ("root", "rep", "leaf", "copies", "kept", "member", "vector")})


def _plain(found):
    return sorted((tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_against_all_pairs(spark):
    """Small leaves and parts, so that vectors spill, clusters stay whole and are cut into parts."""
    rows = _rows()
    want = sorted(_brute(rows), key=str)
    found = _plain(embedding_dups.near_duplicates(_frame(spark, rows), trees=8, leaf_rows=60, part_rows=40))
    assert [x[0] for x in found] == [x[0] for x in want]
    assert all(a[1] <= b[1] for a, b in zip(found, want))
    assert sum(x[1] for x in found) >= 0.99 * sum(x[1] for x in want)
    # One leaf for each label compares everything.
    assert _plain(embedding_dups.near_duplicates(_frame(spark, rows), part_rows=100)) == want


def test_leaves(spark):
    """All but a few pairs at the threshold share a leaf, and leaves are small."""
    rng = np.random.default_rng(4)
    base = embedding_dups.unit(rng.normal(size=(20_000, 64)))
    side = rng.normal(size=base.shape)
    side -= np.einsum("ij,ij->i", side, base)[:, None] * base
    near = 0.93 * base + math.sqrt(1 - 0.93**2) * embedding_dups.unit(side)
    forest = embedding_dups.Forest(embedding_dups.TREES, 0.93, 64)
    # The sample is a fifteenth, so that its nodes end above the leaves and tails go on.
    forest.grow("64:0", base[:1333], 15)
    assert forest.tails
    places = [dict() for _ in range(2)]
    for k, vectors in enumerate((base, near)):
        row, leaf = forest.leaves("64:0", vectors)
        assert len(row) < 25 * len(vectors)
        for r, name in zip(row.tolist(), leaf.tolist()):
            places[k].setdefault(r, set()).add(name)
    assert np.mean([bool(places[0][r] & places[1][r]) for r in range(20_000)]) > 0.9


def test_empty(spark):
    assert embedding_dups.near_duplicates(_frame(spark, [])).count() == 0
    alone = embedding_dups.near_duplicates(_frame(spark, [(1, None, 1)]))
    assert _plain(alone) == [(1, 0, 1, True)]
