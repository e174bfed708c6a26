import math

import numpy as np
from pyspark.sql import functions as F

from countweave.llm import metric_search as M

COLUMNS = ["query_id", "rank", "vec_id", "score"]
SMALL = {"cells": 6, "few": 8, "many": 16}


def brute(rows, asks, k=10):
    whole = []
    for key, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(1024 * float(np.float32(c))) for c in v]
        if sum(c * c for c in x) < 2**62:
            whole.append((key, x))
    out = []
    for i, (key, q) in enumerate(whole):
        if key is not None and asks(key):
            scores = [(-sum(a * b for a, b in zip(q, x, strict=False)), other is None, other or 0) for j, (other, x) in enumerate(whole) if i != j]
            out += [(key, rank, None if null else other, -under) for rank, (under, null, other) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, asks, k=10, **sizes):
    df = spark.createDataFrame([(a, b, "x", 1, 2.0) for a, b in rows], "vec_id long, embedding array<float>, row string, cell int, x double")
    got = M.search(df, asks, k=k, **sizes)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n, width=8, groups=6):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, width))
    x = centers[r.integers(0, groups, n)] + 0.2 * r.normal(size=(n, width))
    x[r.random(n) < 0.3] = x[0]  # a hot vector
    x[r.random(n) < 0.2] *= 3
    return [(int(i), [float(c) for c in v]) for i, v in zip(r.permutation(n), x, strict=True)]


def test_against_brute_force(spark):
    for seed, width in ((1, 8), (2, 3)):
        rows = vectors(seed, 400, width)
        want = brute(rows, lambda k: k % 7 == 0)
        assert run(spark, rows, F.col("vec_id") % 7 == 0, **SMALL) == want
        assert run(spark, rows, F.col("vec_id") % 7 == 0) == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 2.0]), (None, [3.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, []), (7, [0.0, 0.0]), (8, [-1.0, 0.5, 4.0]), (9, [1e30, 0.0]), (10, [1e-9, -1e-9]), (11, [5.0])]
    every = F.col("vec_id").isNotNull()
    for sizes in ({}, {"cells": 3, "few": 2, "many": 2}):
        assert run(spark, rows, every, k=4, **sizes) == brute(rows, lambda k: True, 4)
        assert run(spark, rows, every, k=40, **sizes) == brute(rows, lambda k: True, 40)
    assert run(spark, [], every) == [] and run(spark, [(1, None)], every) == [] and run(spark, [(1, [1.0])], every) == []
    large = [(i, [float(2**i % 1000) * 1e3, 2.0**20, float(i)]) for i in range(60)]
    assert run(spark, large, every, **SMALL) == brute(large, lambda k: True)
    same = [(i, [0.5, 0.25]) for i in range(300)]
    assert run(spark, same, F.col("vec_id") % 50 == 0, **SMALL) == brute(same, lambda k: k % 50 == 0)


def test_tree_bounds_hold_and_spare_distances():
    r = np.random.default_rng(5)
    x = np.floor(1024 * (r.normal(size=(40, 6))[r.integers(0, 40, 3000)] + 0.05 * r.normal(size=(3000, 6))))
    space = M.Space(float((x * x).sum(1).max()))
    ids = r.permutation(3000)
    pages = {p[0]: tuple(np.asarray(c) for c in p[1:]) for p in M.tree(x, ids, np.arange(3000), x[0], space, leaf=32, fan=8)}
    assert sorted(i for c, low, *_ in pages.values() if c[0] < 0 for i in low) == list(range(3000))

    def under(page):
        child, low, row, *_ = pages[page]
        return row if child[0] < 0 else np.concatenate([under(c) for c in child])

    for child, low, _, radius, _, centers in pages.values():
        for c, least, reach, center in zip(child, low, radius, centers, strict=True):
            if c >= 0:
                own = under(c)
                assert space.distances(x[own], center).max() <= reach and ids[own].min() == least
    total = 0
    for i in range(0, 3000, 100):
        best = M.Best(5, None)
        q = x[i]
        computed, spared = M.search_tree(pages, q, float(space.reach(M.dot(x[:1], q, True), float(q @ q))[0]), best, space)
        want = sorted(zip(-M.dot(x, q, True), ids, strict=True))[:5]
        assert list(zip(-best.scores, best.ids, strict=True)) == want
        total += computed
        assert spared > 0
    assert total < 0.5 * 30 * 3000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in M.query(spark, sf).collect()), key=str) == brute(rows, lambda k: k % 100 == 0)
