import math

import pytest
from pyspark.sql import functions as F

from countweave.operators import matrix as M

ROWS = [("d", "c1", "g1", 2.9), ("d", "c1", "g2", 1.0), ("d", "c2", "g1", 4.0), ("d", "c3", "g4", 0.0), ("d", "c3", "g2", 3.0), ("e", "c1", "G1", 1.0), ("e", "c1", "g1", 1.0)]


@pytest.fixture
def x(spark):
    return M.counts(spark.createDataFrame(ROWS, "dataset string, cell string, gene string, value double"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_cut_fractions_and_zeros(x):
    assert rows(x) == [("d", "c1", "g1", 2), ("d", "c1", "g2", 1), ("d", "c2", "g1", 4), ("d", "c3", "g2", 3), ("e", "c1", "G1", 1), ("e", "c1", "g1", 1)]
    assert ("e", "c1", "G1", 2) in rows(M.counts(x, upper=True))


def test_metrics(x):
    assert rows(M.cell_metrics(x)) == [("d", "c1", 3, 2), ("d", "c2", 4, 1), ("d", "c3", 3, 1), ("e", "c1", 2, 2)]
    assert ("d", "g1", 6, 20, 2) in rows(M.gene_metrics(x))
    assert rows(M.mito_share(x, "g")) == [("d", 1.0), ("e", 0.5)]


def test_filter_bounds_are_inclusive_and_metrics_not_recomputed(x):
    assert rows(M.filtered(x, min_genes=2, max_genes=2, min_cells=2)) == [("d", "c1", "g1", 2), ("d", "c1", "g2", 1)]
    assert M.filtered(x, min_counts=7).count() == 0


def test_normalize_moments_scale(x):
    norm = M.normalized(x)
    sums = {(r[0], r[1]): r[2] for r in norm.groupBy("dataset", "cell").agg(F.sum("value")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    m = {(r.dataset, r.gene): r for r in M.gene_moments(norm).collect()}
    values = [2 / 3, 1.0, 0.0]
    mean = sum(values) / 3
    assert abs(m["d", "g1"].norm_mean - mean) < 1e-12
    assert abs(m["d", "g1"].norm_var - sum((v - mean) ** 2 for v in values) / 2) < 1e-12
    assert m["e", "g1"].norm_var is None
    s = {(r.cell, r.gene): r.value for r in M.scaled(norm, norm.where("dataset = 'd'").select("gene").distinct()).where("dataset = 'd'").collect()}
    assert abs(s["c2", "g1"] - 1 / math.sqrt((4 / 9 + 1) / 2)) < 1e-12


def test_gene_values_hold_zeros(x):
    got = M.gene_values(M.normalized(x), x.select("dataset", "cell").distinct(), "g2", log=True, plain_in=("e",))
    assert {(r.dataset, r.cell): r.value for r in got.collect()} == {("d", "c1"): math.log2(1e4 / 3 + 1), ("d", "c2"): 0, ("d", "c3"): math.log2(1e4 + 1), ("e", "c1"): 0}


def test_empty(spark):
    x = spark.createDataFrame([], "dataset string, cell string, gene string, value long")
    assert M.normalized(M.counts(x)).count() == 0 and M.variable_genes(x).count() == 0


def test_quantiles_like_percentile_without_holding_a_group(spark):
    import random

    from pyspark.sql import functions as F

    from countweave.operators import matrix as M

    r = random.Random(5)
    rows = [("a", r.lognormvariate(0, 3)) for _ in range(400)] + [("b", float(r.randrange(5))) for _ in range(90)] + [("c", 7.0), ("e", -1.5), ("e", 2.0), ("f", None), ("g", 1e300), ("g", -1e300), ("g", 3.0)]
    df = spark.createDataFrame(rows, "dataset string, value double")
    levels = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {x.dataset: x.q for x in M.quantiles(df, levels).collect()}
    want = {x.dataset: x.q for x in df.where("value IS NOT NULL").groupBy("dataset").agg(F.percentile("value", F.array(*map(F.lit, levels))).alias("q")).collect()}
    assert got == want
    wide = M.clipped(df, 0.1, 0.9)
    assert wide.count() == len(rows) and "percentile" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_counts_are_added_up_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from countweave import session
    from countweave.plans import fixtures

    monkeypatch.setattr(session, "ROWS", 100)
    rows = [("d", f"c{i % 300}", "gG"[i % 2] + str(i % 7), i % 4) for i in range(2100)]
    df = spark.createDataFrame(rows, "dataset string, cell string, gene string, value long")
    counted, want = M.counts(df, upper=True), {}
    for d, cell, gene, value in rows:
        want[d, cell, gene.upper()] = want.get((d, cell, gene.upper()), 0) + value
    assert {tuple(r)[:3]: r.value for r in counted.collect()} == {key: v for key, v in want.items() if v}
    assert counted.rdd.getNumPartitions() >= 21
    spark.createDataFrame([("R", i % 50, i % 10, 1.0) for i in range(2100)], "l_returnflag string, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "B", i) for i in range(10)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = fixtures.lineitem_counts(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 21 and {(r.cell, r.gene): r.value for r in lines.collect()} == {(str(i % 50), f"B:{i % 10}"): 42 for i in range(50)}
    assert lines._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression") == 2  # the join's tasks as well
