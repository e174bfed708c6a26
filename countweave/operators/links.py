"""Links between genes and the regions around them, by how their values go together over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(genes: DataFrame, peaks: DataFrame, distance: int) -> DataFrame:
    """(gene, peak) of genes (gene, chrom, start, end) and peaks (peak, chrom, start, end) that overlap or are `distance` apart at most.

    A range join by equality: both sides go to the bins of the genome they reach into, bins as wide as the distance, and
    a pair counts in the first bin that both reach. A crowded bin is a key that the join may split.
    """
    width = max(1, distance)
    reach = genes.select("gene", "chrom", (F.col("start") - distance).alias("low"), (F.col("end") + distance).alias("high"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("bin")
    left = reach.select("gene", "chrom", "low", "high", bins("low", "high"))
    right = peaks.select("peak", "chrom", "start", "end", bins("start", "end"))
    first = F.floor(F.greatest("low", "start") / width)
    return left.join(right, ["chrom", "bin"]).where((F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low")) & (F.col("bin") == first)).select("gene", "peak")


def correlated(pairs: DataFrame, genes: DataFrame, peaks: DataFrame, n_cells: int) -> DataFrame:
    """(gene, peak, correlation) of pairs (gene, peak), by Pearson over n_cells cells, for values (cell, gene, value) and (cell, peak, value) without zeros.

    Only cells that hold both add products; all others are in the sums of each side. Null where a side does not vary.
    Ranks for values give Spearman's.
    """
    x, y = F.col("value").cast("double"), F.col("other").cast("double")
    sums = lambda df, name, a: df.groupBy(name).agg(F.sum(x).alias(a), F.sum(x * x).alias(a * 2))
    own = pairs.join(genes.select("gene", "cell", "value"), "gene").join(peaks.select("peak", "cell", F.col("value").alias("other")), ["peak", "cell"])
    both = own.groupBy("gene", "peak").agg(F.sum(x * y).alias("xy"))
    joined = pairs.join(both, ["gene", "peak"], "left").join(sums(genes, "gene", "x"), "gene").join(sums(peaks, "peak", "y"), "peak")
    spread = (n_cells * F.col("xx") - F.col("x") * F.col("x")) * (n_cells * F.col("yy") - F.col("y") * F.col("y"))
    together = n_cells * F.coalesce("xy", F.lit(0.0)) - F.col("x") * F.col("y")
    return joined.select("gene", "peak", F.when(spread > 0, together / F.sqrt(spread)).alias("correlation"))


def linked(genes: DataFrame, gene_places: DataFrame, peaks: DataFrame, peak_places: DataFrame, distance: int = 500_000, least: float | None = None) -> DataFrame:
    """(gene, peak, correlation) of the pairs within distance, with `least` those whose correlation is so far from 0; cells are those of either table."""
    n = genes.select("cell").union(peaks.select("cell")).distinct().count()
    found = correlated(near(gene_places, peak_places, distance), genes, peaks, n)
    return found if least is None else found.where(F.abs("correlation") >= least)
