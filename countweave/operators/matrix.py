"""Preprocessing of count matrices in long form: (dataset, cell, gene, value), zeros absent.

Everything is keyed by names, so datasets may hold different genes in any order. A null value is absent; a null cell or
gene is a key of its own, as in any GROUP BY.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

CELL, GENE = ["dataset", "cell"], ["dataset", "gene"]


def counts(df: DataFrame, upper: bool = False) -> DataFrame:
    """Whole counts, fractions cut off, without zeros; with upper, genes that differ in case only become one."""
    whole = df.select("dataset", "cell", "gene", F.col("value").cast("bigint").alias("value"))
    if upper:
        whole = session.cut(whole.withColumn("gene", F.upper("gene")), "counts")
        whole = session.dealt(whole, whole.count(), "dataset", "cell", "gene").groupBy("dataset", "cell", "gene").agg(F.sum("value").alias("value"))
    return whole.where("value != 0")


def cell_metrics(x: DataFrame) -> DataFrame:
    """(dataset, cell, n_umi, n_gene)."""
    return x.groupBy(*CELL).agg(F.sum("value").alias("n_umi"), F.count("*").alias("n_gene"))


def gene_metrics(x: DataFrame) -> DataFrame:
    """(dataset, gene, gene_sum, gene_sum_sq, n_cell)."""
    return x.groupBy(*GENE).agg(F.sum("value").alias("gene_sum"), F.sum(F.col("value") * F.col("value")).alias("gene_sum_sq"), F.count("*").alias("n_cell"))


def mito_share(x: DataFrame, prefix: str = "MT-") -> DataFrame:
    """(dataset, mt_pct): the share of a dataset's genes (not counts) whose name starts with prefix."""
    return x.select(*GENE).distinct().groupBy("dataset").agg(F.avg(F.col("gene").startswith(prefix).cast("int")).alias("mt_pct"))


def mito_counts(x: DataFrame, prefix: str = "MT-") -> DataFrame:
    """(dataset, cell, mito): the share of a cell's counts in such genes."""
    return x.groupBy(*CELL).agg((F.sum(F.when(F.col("gene").startswith(prefix), F.col("value")).otherwise(0)) / F.sum("value")).alias("mito"))


def filtered(x: DataFrame, min_genes=0, max_genes=math.inf, min_cells=0, max_cells=math.inf, min_counts=0, max_counts=math.inf) -> DataFrame:
    """x without cells and genes whose metrics (both of x as it was given) are outside the bounds, which are inclusive."""
    cells = cell_metrics(x).where(F.col("n_gene").between(min_genes, F.lit(float(max_genes)))).select(*CELL)
    genes = gene_metrics(x).where(F.col("n_cell").between(min_cells, F.lit(float(max_cells))) & F.col("gene_sum").between(min_counts, F.lit(float(max_counts)))).select(*GENE)
    return x.join(cells, CELL, "left_semi").join(genes, GENE, "left_semi").select(*x.columns)


def top_cells(x: DataFrame, n: int) -> DataFrame:
    """x of the n cells of each dataset with most counts (ties by name)."""
    order = Window.partitionBy("dataset").orderBy(F.desc("n_umi"), "cell")
    return x.join(cell_metrics(x).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select(*CELL), CELL, "left_semi")


def normalized(x: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Each cell's values over their sum. The sums are pre-aggregated and joined back on the cell; cells: a table of `cell_metrics` that has them already."""
    sums = x.groupBy(*CELL).agg(F.sum("value").alias("s")) if cells is None else cells.select(*CELL, F.col("n_umi").alias("s"))
    return x.join(sums, CELL).select("dataset", "cell", "gene", (F.col("value") / F.col("s")).alias("value"))


def dataset_sizes(x: DataFrame) -> DataFrame:
    """(dataset, n_cells)."""
    return x.groupBy("dataset").agg(F.countDistinct("cell").alias("n_cells"))


def gene_moments(norm: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(dataset, gene, norm_sum, norm_sum_sq, norm_mean, norm_var) over all cells, absent values as 0; the variance is the sample's. sizes: `dataset_sizes`, if they are known."""
    sums = norm.groupBy(*GENE).agg(F.sum("value").alias("norm_sum"), F.sum(F.col("value") * F.col("value")).alias("norm_sum_sq"))
    n = F.col("n_cells")
    var = F.when(n > 1, F.greatest(F.col("norm_sum_sq") - F.col("norm_sum") * F.col("norm_sum") / n, F.lit(0.0)) / (n - 1))
    return sums.join(dataset_sizes(norm) if sizes is None else sizes, "dataset").select(*GENE, "norm_sum", "norm_sum_sq", (F.col("norm_sum") / n).alias("norm_mean"), var.alias("norm_var"))


def _variable(x: DataFrame, alpha: float, threshold: float | dict[str, float], num_genes: int | None) -> tuple[DataFrame, DataFrame]:
    """((dataset, gene), the moments of all genes): genes whose variance is over what Poisson counts of its mean would have, by the mean's confidence bound and by `threshold` in log10; with num_genes, the so many of each dataset that are most over it."""
    each = session.cut(cell_metrics(x), "cells")  # one row a cell
    cells = each.groupBy("dataset").agg(F.avg(1 / F.col("n_umi")).alias("c"), F.count("*").alias("n_cells"))
    moments = session.cut(gene_moments(normalized(x, each), cells.select("dataset", "n_cells")).join(cells, "dataset"), "moments")  # one row a gene
    # The bound's quantile depends on the number of genes: one of a dataset, made on the driver.
    deviations = {r["dataset"]: NormalDist().inv_cdf(1 - alpha / r["n"] / 2) for r in moments.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    over = {d: threshold.get(d, 0.1) if isinstance(threshold, dict) else threshold for d in deviations}
    of = lambda table: F.coalesce(*[F.when(F.col("dataset").eqNullSafe(F.lit(d)), F.lit(float(v))) for d, v in table.items()], F.lit(0.0))
    mean, var, c = F.col("norm_mean"), F.col("norm_var"), F.col("c")
    upper, excess = mean + of(deviations) * F.sqrt(mean * c / F.col("n_cells")), F.log10(var) - F.log10(mean * c)
    passed = moments.where(var / c > upper)
    if num_genes is None:
        return passed.where(F.log10(var) > F.log10(mean * c) + of(over)).select(*GENE), moments
    order = Window.partitionBy("dataset").orderBy(F.desc(F.round(excess, 9)), "gene")
    return passed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= num_genes).select(*GENE), moments


def variable_genes(x: DataFrame, alpha: float = 0.99, threshold: float | dict[str, float] = 0.1, combine: str = "union", keep_unique: bool = False, num_genes: int | None = None, written: bool = False) -> DataFrame:
    """(gene) that vary more than chance in any dataset (combine="union") or in all ("intersection"); without keep_unique, only those that all datasets hold. written: x is a table already, which several aggregations read as it is."""
    x = x if written else session.cut(x, "counts")  # read by several aggregations
    chosen, moments = _variable(x, alpha, threshold, num_genes)
    n = moments.select("dataset").distinct().count()
    genes = chosen.groupBy("gene").agg(F.count("*").alias("n")).where(F.lit(combine == "union") | (F.col("n") == n)).select("gene")
    return genes if keep_unique else genes.join(shared_genes(moments, n), "gene", "left_semi")


def united(x: DataFrame) -> DataFrame:
    """(dataset, gene, gene_sum, n_cell) of every gene of any dataset in every dataset, 0 where it has none of it: the rows that a union of genes fills up."""
    genes, datasets = x.select("gene").distinct(), x.select("dataset").distinct()
    grid = genes.join(datasets, F.lit(True))  # datasets are few
    own = gene_metrics(x).select(*GENE, "gene_sum", "n_cell")
    return grid.join(own, GENE, "left").na.fill(0, ["gene_sum", "n_cell"]).select(*GENE, "gene_sum", "n_cell")


def dataset_of(x: DataFrame, name: str) -> DataFrame:
    """The rows of one dataset; an unknown name is an error."""
    own = x.where(F.col("dataset") == name)
    if own.isEmpty():
        raise KeyError(name)
    return own


def shared_genes(x: DataFrame, n: int | None = None) -> DataFrame:
    """(gene) that all datasets hold."""
    n = x.select("dataset").distinct().count() if n is None else n
    return x.select(*GENE).distinct().groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") == n).select("gene")


def scaled(norm: DataFrame, genes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Values of the given genes over their root mean square, sqrt(sum of squares / (cells - 1)), not centered. sizes: `dataset_sizes`, if they are known."""
    own = session.cut(norm.join(genes.select("gene"), "gene", "left_semi"), "chosen")  # read twice, for the squares and the values
    squares = own.groupBy(*GENE).agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    rms = squares.join(dataset_sizes(norm) if sizes is None else sizes, "dataset").select(*GENE, F.sqrt(F.col("sq") / (F.col("n_cells") - 1)).alias("rms"))
    return own.join(rms, GENE).where("rms > 0").select("dataset", "cell", "gene", (F.col("value") / F.col("rms")).alias("value"))


def gene_values(x: DataFrame, cells: DataFrame, gene: str, log: bool = False, factor: float = 1e4, plain_in: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, cell, value) of one gene for all cells, absent ones 0; with log, log2(value * factor + 1) except in the datasets plain_in."""
    value = F.coalesce("value", F.lit(0.0))
    if log:
        value = F.when(F.col("dataset").isin(*plain_in), value).otherwise(F.log2(value * factor + 1)) if plain_in else F.log2(value * factor + 1)
    return cells.select(*CELL).join(x.where(F.col("gene") == gene).select(*CELL, "value"), CELL, "left").select(*CELL, value.alias("value"))


def by_group(values: DataFrame, group: str | Column) -> DataFrame:
    """values with `scaled`: over the population deviation of their group (0 where that is 0)."""
    sd = F.stddev_pop("value").over(Window.partitionBy(group))
    return values.withColumn("scaled", F.when(sd > 0, F.col("value") / sd).otherwise(F.lit(0.0)))


#: Slices of a group's range of values whose rows are counted to find its quantiles.
SLICES = 65_536


def quantiles(values: DataFrame, levels: list[float], group: str = "dataset", value: str = "value") -> DataFrame:
    """(group, q): exact quantiles of each group's values that are not null, by linear interpolation.

    Equal values are counted, then the slices of each group's range; only slices that hold a quantile are ordered, each
    by itself. No task holds a group.
    """
    x = F.col(value).cast("double").alias("x")
    counted = session.cut(values.where(F.col(value).isNotNull()).groupBy(group, x).agg(F.count("*").alias("n")), "counted")
    ends = counted.groupBy(group).agg(F.min("x").alias("low"), F.max(F.when(~F.isnan("x"), F.col("x"))).alias("high"))
    share = F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low"))
    place = F.when(share.isNotNull() & ~F.isnan(share), F.floor(share * SLICES)).otherwise(F.lit(SLICES + 1).cast("bigint"))
    sliced = counted.join(F.broadcast(ends), group).select(group, "x", "n", place.alias("slice"))  # a row a group
    own = Window.partitionBy(group)
    sizes = sliced.groupBy(group, "slice").agg(F.sum("n").alias("size"))  # SLICES of a group
    upto = F.sum("size").over(own.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select(group, "slice", "size", (upto - F.col("size")).alias("before"), F.sum("size").over(own).alias("all"))
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("all") - 1) * F.lit(float(p))).alias("at"), F.lit(side).alias("side")) for i, p in enumerate(levels) for side in (0, 1)]))
    rank = F.when(F.col("l.side") == 0, F.floor("l.at")).otherwise(F.ceil("l.at"))
    wanted = sizes.select("*", level.alias("l")).select(group, "slice", "size", "before", "l.i", "l.at", "l.side", rank.alias("rank")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
    wanted = session.cut(wanted, "wanted")  # two rows a level
    some = sliced.join(F.broadcast(wanted.select(group, "slice", "before").distinct()), [group, "slice"])
    last = F.col("before") + F.sum("n").over(Window.partitionBy(group, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    met = some.withColumn("last", last).select(group, "slice", "x", "n", "last").join(F.broadcast(wanted.drop("before", "size")), [group, "slice"]).where((F.col("rank") < F.col("last")) & (F.col("rank") >= F.col("last") - F.col("n")))
    both = met.groupBy(group, "i", "at").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("hi"))
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    return both.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))).alias("p")).select(group, F.col("p.q").alias("q"))  # a level each


def clipped(values: DataFrame, low: float, high: float, group: str = "dataset") -> DataFrame:
    """values held between two quantiles (linear interpolation) of the group's non-zero ones."""
    bounds = quantiles(values.where("value != 0"), [low, high], group)
    joined = values.where(F.col(group).isNotNull()).join(F.broadcast(bounds), group, "left")
    return joined.withColumn("value", F.when(F.col("value") == 0, F.col("value")).otherwise(F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1]))).drop("q")


def centers(points: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, x, y): the median place of each group."""
    return points.groupBy(group).agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"))


def exported(x: DataFrame) -> DataFrame:
    """log2(1e4 * share + 1), the values a cell browser shows."""
    return normalized(x).withColumn("value", F.log2(F.col("value") * 1e4 + 1))


def subset(x: DataFrame, cells: DataFrame) -> DataFrame:
    return x.join(cells.select(*CELL), CELL, "left_semi")


def reorganized(x: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """x with datasets after a column of the cell table; cells are named dataset:cell."""
    return x.join(cells.select(*CELL, F.col(by).cast("string").alias("to")), CELL).select(F.col("to").alias("dataset"), F.concat_ws(":", *CELL).alias("cell"), "gene", "value")
