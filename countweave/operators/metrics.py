"""How two labellings, or an alignment, agree; and marker genes of factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .factorize import Factors, loadings, specificity
from .ranks import rank_test


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def purity(labels: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(purity): the share of rows in their cluster's most common class."""
    best = contingency(labels, cluster, truth).groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg((F.sum("m") / F.sum("n")).alias("purity"))


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): the adjusted Rand index of two labellings of the same rows."""
    table = contingency(labels, a, b)
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    both = table.agg(pairs(F.col("n").cast("double")).alias("x"), F.sum("n").cast("double").alias("n"))
    one = table.groupBy(a).agg(F.sum("n").cast("double").alias("n")).agg(pairs(F.col("n")).alias("a"))
    two = table.groupBy(b).agg(F.sum("n").cast("double").alias("n")).agg(pairs(F.col("n")).alias("b"))
    x, p, q, all_ = F.col("x"), F.col("a"), F.col("b"), F.col("n") * (F.col("n") - 1) / 2
    chance = p * q / all_
    joined = both.join(one, F.lit(True)).join(two, F.lit(True))  # one row each
    return joined.select(F.when((p + q) / 2 == chance, F.lit(1.0)).otherwise((x - chance) / ((p + q) / 2 - chance)).alias("ari"))


def mixing_share(neighbours: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, share): of each cell's neighbours, those of another dataset; cells (id, dataset)."""
    ends = neighbours.join(cells.select(F.col("id").alias("src"), F.col("dataset").alias("d1")), "src").join(cells.select(F.col("id").alias("dst"), F.col("dataset").alias("d2")), "dst")
    return ends.groupBy(F.col("src").alias("id")).agg(F.avg((F.col("d1") != F.col("d2")).cast("int")).alias("share"))


def agreement(before: DataFrame, after: DataFrame, cells: DataFrame, k: int, sample: int | None = None, seed: int = 1) -> DataFrame:
    """(dataset, cells, agreement): how much of their `k` neighbours cells keep, on average.

    before and after: neighbours (src, dst) of the same cells, as in a dataset by itself and in the aligned space; cells
    (id, dataset). sample: of each dataset so many cells, by hash.
    """
    some = cells.select("id", "dataset")
    if sample is not None:
        order = Window.partitionBy("dataset").orderBy(F.xxhash64("id", F.lit(seed)), "id")
        some = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).drop("place")
    chosen = lambda near: near.select(F.col("src").alias("id"), "dst").join(some.select("id"), "id", "left_semi")
    kept = chosen(before).join(chosen(after), ["id", "dst"]).groupBy("id").agg(F.count("*").alias("n"))
    return some.join(kept, "id", "left").groupBy("dataset").agg(F.count("*").alias("cells"), (F.sum(F.coalesce("n", F.lit(0))) / (k * F.count("*"))).alias("agreement"))


def alignment(neighbours: DataFrame, cells: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(alignment), with `by` (by, alignment): 1 where a cell's k neighbours are of its own dataset as often as by chance, 0 where always.

    1 - (own - k / n) / (k - k / n), with own the mean number of neighbours of a cell's dataset and n the number of
    datasets, all cells alike. neighbours (src, dst), a cell itself not counted; cells (id, dataset, and by).
    """
    n = cells.select("dataset").distinct().count()
    ends = neighbours.where("src != dst").join(cells.withColumnRenamed("id", "src").withColumnRenamed("dataset", "d1"), "src")
    ends = ends.join(cells.select(F.col("id").alias("dst"), F.col("dataset").alias("d2")), "dst")
    own = ends.groupBy("src", *([by] if by else [])).agg(F.sum((F.col("d1") == F.col("d2")).cast("int")).alias("own"))
    value = 1 - (F.avg("own") - k / n) / (k - k / n)
    return own.groupBy(*([by] if by else [])).agg(value.alias("alignment"))


def top_genes(loadings_long: DataFrame, n: int) -> DataFrame:
    """(factor, gene, loading, rank): the n genes of the largest loadings of each factor (ties by name)."""
    order = Window.partitionBy("factor").orderBy(F.desc("loading"), "gene")
    return loadings_long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def factor_markers(norm: DataFrame, cells: DataFrame, f: Factors, one: str, two: str, share: float = 10, log_fc: float = 1, p: float = 0.05, n: int = 30) -> DataFrame:
    """(part, factor, gene, log_fc, pval): genes of the factors that two datasets share within `share` percent.

    Part one and two: of each factor's cells (dataset, cell, cluster) the genes that a rank test puts higher in one
    dataset, by log_fc and p; of those the n with the largest loadings there. Part shared: the n largest of the lesser
    of both datasets' loadings.
    """
    spark, apart = norm.sparkSession, np.abs(specificity(f, one, two))
    close = [int(i) for i in np.flatnonzero(apart <= share)]
    long = loadings(spark, f).where(F.col("dataset").isin(one, two)).select("dataset", "gene", F.posexplode(F.zip_with("w", "v", lambda a, b: a + b)).alias("factor", "loading")).where(F.col("factor").isin(close))
    both = long.groupBy("factor", "gene").agg(F.min("loading").alias("loading"))
    out = top_genes(both, n).select(F.lit("shared").alias("part"), "factor", "gene", F.lit(None).cast("double").alias("log_fc"), F.lit(None).cast("double").alias("pval"))
    name = F.concat_ws("\t", "dataset", "cell")
    x = norm.select(name.alias("cell"), "gene", "value")
    own = cells.where(F.col("cluster").isin(close) & F.col("dataset").isin(one, two)).select(name.alias("cell"), F.col("dataset").alias("group"), F.col("cluster").cast("int").alias("factor"))
    tests = rank_test(x, own, within="factor").where((F.col("log_fc") > log_fc) & (F.col("pval") < p))
    ranked = tests.select("factor", "gene", F.col("group").alias("dataset"), "log_fc", "pval").join(long, ["dataset", "factor", "gene"])
    order = Window.partitionBy("factor", "dataset").orderBy(F.desc("loading"), "gene")
    best = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return out.unionByName(best.select(F.col("dataset").alias("part"), "factor", "gene", "log_fc", "pval"))
