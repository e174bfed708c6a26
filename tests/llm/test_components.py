import random

import pytest

from countweave.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("small", [1000, 0])
def test_against_union_find(spark, small):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(-5, i) for i in range(200, 260)]
    some = [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    edges = [*chain, *star, *some, (1, 1), (None, 3), (4, None), *star[:5]]
    r.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), small=small)
    assert sorted(tuple(x) for x in got.collect()) == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long"), small=small).collect() == []
