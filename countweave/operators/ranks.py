"""Rank tests over sparse values: only stored values are ranked, absent ones are one tie at the bottom."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import session

FLOOR = 1e-10


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """2 * P(Z > abs(z)) of a normal variable."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan for v in z], dtype="float64")


def average_ranks(values: DataFrame, by: list[str], value: str = "value", absent: str | None = None) -> DataFrame:
    """values with `rank` (ties share their mean) within each group of `by`, and `ties` rows of that value.

    absent: a column with how many more rows, all smaller, the group has. Groups are counted by value before they are
    ranked, so the window runs over distinct values only, and ties are joined back.
    """
    groups = values.groupBy(*by, value, *([absent] if absent else [])).agg(F.count("*").alias("ties"))
    below = F.coalesce(F.sum("ties").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = below + (F.col("ties") + 1) / 2 + (F.col(absent) if absent else F.lit(0))
    return values.join(groups.select(*by, value, "ties", rank.alias("rank")), [*by, value])


def rank_test(values: DataFrame, cells: DataFrame, group: str = "group", within: str | None = None) -> DataFrame:
    """One against the rest, for every group of cells and feature.

    values: (cell, gene, value > 0), cells: (cell, group); cells without a group do not count. Gives (gene, group,
    avg_expr, log_fc, statistic, z, pval, padj): the mean of ln(value + 1e-10) in the group, less that of the other
    cells; the smaller Mann-Whitney U; its normal deviate with continuity and tie correction; p two-sided, adjusted
    by Benjamini and Hochberg over the genes of a group. With one group, or one that is all cells, nothing comes.

    within: a column of cells; those of each of its values are tested for themselves, all at once, and it comes first.
    """
    cells = cells.where(F.col(group).isNotNull()).select("cell", F.col(group).alias("group"), (F.col(within) if within else F.lit(0)).alias("part"))
    sizes = cells.groupBy("part", "group").agg(F.count("*").alias("n1"))
    total = sizes.groupBy("part").agg(F.sum("n1").alias("n"), F.collect_list(F.struct("group", "n1")).alias("groups"))  # a pair for each group
    x, place = values.where("value > 0").join(cells, "cell"), ["part", "gene"]
    alike = x.groupBy(*place, "value", "group").agg(F.count("*").alias("m"))
    rising = Window.partitionBy(*place).orderBy("value")  # one order gives the ties and all that is smaller, so rows are dealt once
    ties, upto = F.sum("m").over(rising.rangeBetween(Window.currentRow, Window.currentRow)), F.sum("m").over(rising.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = alike.withColumn("ties", ties).withColumn("rank", upto - F.col("ties") + (F.col("ties") + 1) / 2)
    cube = lambda c: c * c * c - c
    m, tied = F.col("m"), F.col("ties").cast("double") * F.col("ties") - 1
    sums = ranked.groupBy(*place, "group").agg(F.sum(F.col("rank") * m).alias("r"), F.sum("m").alias("k"), F.sum(F.ln(F.col("value") + FLOOR) * m).alias("logs"), F.sum(tied * m).alias("tied"))
    sums = session.cut(sums, "sums")  # a row for each feature and group
    whole = sums.groupBy(*place).agg(F.sum("logs").alias("all_logs"), F.sum("k").alias("all_k"), F.sum("tied").alias("tied"))
    n, z0 = F.col("n").cast("double"), F.col("absent").cast("double")
    ties = whole.join(total.select("part", "n"), "part").withColumn("absent", F.col("n") - F.col("all_k")).select(*place, "n", "absent", "all_logs", "all_k", (1 - (F.col("tied") + cube(z0)) / cube(n)).alias("t"))
    every = ties.join(total.select("part", "groups"), "part").withColumn("g", F.explode("groups")).select(*place, "n", "absent", "all_logs", "all_k", "t", "g.group", "g.n1")
    all_ = every.join(sums.drop("tied"), [*place, "group"], "left").na.fill(0, ["r", "k", "logs"])
    low, n1 = F.lit(math.log(FLOOR)), F.col("n1").cast("double")
    n2 = n - n1
    r1 = F.col("r") + F.col("k") * z0 + (n1 - F.col("k")) * (z0 + 1) / 2
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - r1
    inside = F.col("logs") + (n1 - F.col("k")) * low
    outside = F.col("all_logs") - F.col("logs") + (n2 - (F.col("all_k") - F.col("k"))) * low
    z = (F.greatest(u1, n1 * n2 - u1) - (n1 * n2 / 2 + 0.5)) / F.sqrt(F.col("t") * n1 * n2 * (n + 1) / 12)
    out = all_.where(n2 > 0).select(*place, "group", (inside / n1).alias("avg_expr"), (inside / n1 - outside / n2).alias("log_fc"), F.least(u1, n1 * n2 - u1).alias("statistic"), z.alias("z"))
    tests = adjusted(out.withColumn("pval", normal_tail("z")), ["part", "group"])
    return tests.withColumnRenamed("part", within) if within else tests.drop("part")


def adjusted(tests: DataFrame, by: list[str], p: str = "pval") -> DataFrame:
    """tests with padj, by Benjamini and Hochberg within each group of `by`; null p values stay null."""
    rising = Window.partitionBy(*by).orderBy(p)
    above = Window.partitionBy(*by).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = tests.withColumn("__n", F.count(p).over(Window.partitionBy(*by))).withColumn("__r", F.count(p).over(rising.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    raw = ranked.withColumn("__q", F.col(p) * F.col("__n") / F.col("__r"))
    return raw.withColumn("padj", F.when(F.col(p).isNotNull(), F.least(F.min("__q").over(above), F.lit(1.0)))).drop("__n", "__r", "__q")


def wilcoxon(norm: DataFrame, clusters: DataFrame, compare: str = "clusters") -> DataFrame:
    """rank_test over shares of shared genes: clusters (dataset, cell, cluster) against the other cells, or (compare="datasets") the datasets within each cluster of two or more, as groups cluster-dataset."""
    named = F.concat_ws("\t", "dataset", "cell")
    n = norm.select("dataset").distinct().count()
    genes = norm.select("dataset", "gene").distinct().groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") == n).select("gene")
    x = norm.join(genes, "gene", "left_semi").select(named.alias("cell"), "gene", "value")
    if compare == "clusters":
        return rank_test(x, clusters.select(named.alias("cell"), F.col("cluster").cast("string").alias("group")))
    if compare != "datasets":
        raise ValueError("compare is clusters or datasets")
    mixed = clusters.groupBy("cluster").agg(F.countDistinct("dataset").alias("n")).where("n > 1").select("cluster")
    own = clusters.join(mixed, "cluster", "left_semi")
    return rank_test(x, own.select(named.alias("cell"), F.concat_ws("-", F.col("cluster").cast("string"), "dataset").alias("group"), "cluster"), within="cluster").drop("cluster")


def placed(df: DataFrame, *order) -> DataFrame:
    """df with place, 1, 2 .. in this order, which has to tell all rows: a range sort, and the sizes of the partitions before, one number each."""
    sorted_ = session.cut(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    sizes = sorted_.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    starts = df.sparkSession.createDataFrame(before, "part long, before long")
    return sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before")


def _running(hits: DataFrame, n: int, *by: str) -> DataFrame:
    """(by.., size, es): for hits (by.., place, weight) among n places, the largest deviation of the share of weight met from the share of other places met."""
    own = Window.partitionBy(*by)
    upto = own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seen = hits.withColumn("m", F.count("*").over(own)).withColumn("all", F.sum("weight").over(own)).withColumn("j", F.count("*").over(upto)).withColumn("met", F.sum("weight").over(upto))
    share = lambda x: F.when(F.col("all") > 0, x / F.col("all")).otherwise(0.0)
    missed = F.when(F.lit(n) > F.col("m"), (F.col("place") - F.col("j")) / (F.lit(n) - F.col("m"))).otherwise(0.0)
    after, before = share(F.col("met")) - missed, share(F.col("met") - F.col("weight")) - missed  # it only turns at hits
    high, low = F.max(after), F.min(before)
    return seen.groupBy(*by).agg(F.first("m").alias("size"), F.when(high >= -low, high).otherwise(low).alias("es"))


def ranked_enrichment(ranking: DataFrame, sets: DataFrame, permutations: int = 0, power: float = 1.0, seed: int = 1) -> DataFrame:
    """(set, size, es), with permutations also nes and pval, for sets (set, gene) on a ranking (gene, score), highest first, ties by gene.

    es: walking down the ranking, the sum rises by abs(score) ** power over that of all of the set at its genes and falls
    evenly at others; es is where it is furthest from 0. A permutation deals the genes to the places anew, by a hash of
    gene, seed and its number: all permutations are rows of one table. pval: of those of the same sign the share, plus
    one, that reaches as far; nes: es over their mean.
    """
    placed_ = session.cut(placed(ranking.select("gene", "score"), F.col("score").desc(), F.col("gene")), "placed")
    n = placed_.count()
    weight = F.pow(F.abs("score"), F.lit(power)).alias("weight")
    own = sets.select("set", "gene").distinct()
    found = _running(own.join(placed_.select("gene", "place", weight), "gene"), n, "set")
    if not permutations:
        return found
    dealt = placed_.select("gene").withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = Window.partitionBy("turn").orderBy(F.xxhash64("gene", "turn", F.lit(seed)), "gene")  # of one permutation
    drawn = dealt.withColumn("place", F.row_number().over(order).cast("long")).join(placed_.select("place", weight), "place")
    chance = _running(own.join(drawn, "gene"), n, "set", "turn").select("set", F.col("es").alias("other"))
    alike = found.join(chance, "set").where(F.signum("es") == F.signum("other"))
    stats = alike.groupBy("set").agg(F.count("*").alias("n"), F.count_if(F.abs("other") >= F.abs("es")).alias("far"), F.avg(F.abs("other")).alias("mean"))
    pval = (F.coalesce("far", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 1)
    return found.join(stats, "set", "left").select("set", "size", "es", (F.col("es") / F.col("mean")).alias("nes"), pval.alias("pval"))
