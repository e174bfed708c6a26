import math

import numpy as np

from countweave.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, v string, part int"


def brute(rows):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v, _ in rows]
    links, parent = [0] * len(rows), {k: k for k, _, _ in rows if k is not None}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            b, _, lb = rows[j]
            if la is not None and la == lb and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                if a is not None and b is not None:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return sorted(((k, n, None if k is None else find(k), k is not None and find(k) == k) for (k, _, _), n in zip(rows, links, strict=True)), key=str)


def run(spark, rows, **kw):
    return sorted([tuple(r) for r in E.link(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **kw).collect()], key=str)


def vectors(seed, n):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 4, 16))
    rows = []
    for i in range(n):
        v = base[r.integers(len(base))] + r.standard_normal(16) * r.choice([0, 0.02, 0.12, 0.2])
        rows.append((i * 2, [float(x) for x in np.float32(v * r.choice([1, 3]))], int(r.integers(3))))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(1, 160)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, cell=10) == brute(rows)
    monkeypatch.setattr(E, "HELD", 7)
    assert run(spark, rows, cell=10) == brute(rows)


def test_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, one, None), (8, one, 1), (9, one, 1), (9, one, 1), (10, [2.0, 4.0, 6.0], 1), (11, one, 2), (None, one, 1), (12, [3e38, 3e38], 1), (13, [1e-38, 1e-38], 1), (14, [1.0], 1), (15, [-1.0], 1)]
    assert [r for r in run(spark, rows) if r[0] not in (12, 13)] == [r for r in brute(rows) if r[0] not in (12, 13)]
    assert {r[0]: r[1] for r in run(spark, rows)}[12] == 1
    assert run(spark, []) == []


def test_calibration():
    p = math.erf(E.WINDOW / math.sqrt(2))
    k = E.needed()
    assert sum(math.comb(16, i) * p**i * (1 - p) ** (16 - i) for i in range(k)) <= E.MISSED
