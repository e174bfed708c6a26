"""Tables behind the usual figures; drawing them is left to any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import matrix


def scatter(points: DataFrame, cells: DataFrame, seed: int = 1) -> DataFrame:
    """(dataset, cell, x, y, cluster, place) of points (dataset, cell, x, y) and cells (dataset, cell, cluster); place orders the dots of a dataset at random, so none hides the others."""
    order = Window.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", "cell", F.lit(seed)).cast("binary")), "cell")
    return points.join(cells.select("dataset", "cell", "cluster"), ["dataset", "cell"]).withColumn("place", F.row_number().over(order))


def expression(norm: DataFrame, points: DataFrame, gene: str, scale_by: str | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """(dataset, cell, x, y, value): a gene over the points, its zeros null; scaled by the deviation of a group and clipped at quantiles of each dataset if asked."""
    values = matrix.gene_values(norm, points, gene, log=True)
    if scale_by:
        values = matrix.by_group(values, scale_by).select("dataset", "cell", F.col("scaled").alias("value"))
    if clip:
        values = matrix.clipped(values, *clip).select("dataset", "cell", "value")
    return points.join(values, ["dataset", "cell"]).withColumn("value", F.when(F.col("value") != 0, F.col("value")))


def variance_mean(x: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset, gene, mean, variance, chosen): log10 of both, and whether the gene is among the chosen."""
    chosen = genes.select("gene", F.lit(True).alias("chosen"))
    moments = matrix.gene_moments(matrix.normalized(x)).join(chosen, "gene", "left")
    return moments.select("dataset", "gene", F.log10("norm_mean").alias("mean"), F.log10("norm_var").alias("variance"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


def loading_ranks(loadings: DataFrame) -> DataFrame:
    """(factor, gene, loading, rank) with rank 1 the smallest loading of its factor, ties by gene; loadings (factor, gene, loading)."""
    return loadings.withColumn("rank", F.row_number().over(Window.partitionBy("factor").orderBy("loading", "gene")))


def proportions(cells: DataFrame, group: str = "cluster") -> DataFrame:
    """(dataset, group, n, share): how a dataset's cells spread over the groups."""
    n = cells.groupBy("dataset", group).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))


def term_table(terms: DataFrame, representative: DataFrame, ic: DataFrame, most: int = 50, user: DataFrame | None = None) -> DataFrame:
    """(go, name, pval, frequency, representative, members, user): the `most` groups of smallest p, one row a representative; user: the sum of (go, value) over a group."""
    members = terms.join(representative, "go")
    if user is not None:
        members = members.join(user, "go", "left")
    else:
        members = members.withColumn("value", F.lit(None).cast("double"))
    groups = members.groupBy("representative").agg(F.count("*").alias("members"), F.sum("value").alias("user"))
    best = groups.join(terms, F.col("representative") == F.col("go")).join(ic.select("go", "frequency"), "go", "left")
    return best.select("go", "name", "pval", "frequency", "representative", "members", "user").orderBy("pval", "go").limit(most)


def term_members(terms: DataFrame, representative: DataFrame, ic: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """(representative, representative_name, go, name, pval, frequency, value, place): every term of every group, the representative first, then by p and id; user: (go, value)."""
    named = representative.join(terms.select(F.col("go").alias("representative"), F.col("name").alias("representative_name")), "representative")
    rows = terms.join(named, "go").join(ic.select("go", "frequency"), "go", "left")
    rows = rows.withColumn("value", F.lit(None).cast("double")) if user is None else rows.join(user.select("go", "value"), "go", "left")
    order = Window.partitionBy("representative").orderBy(F.col("go") != F.col("representative"), "pval", "go")
    return rows.withColumn("place", F.row_number().over(order)).select("representative", "representative_name", "go", "name", "pval", "frequency", "value", "place")
