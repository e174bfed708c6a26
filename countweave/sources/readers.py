"""Readers and writers of count matrices and the tables around them. Everything is read by Spark, from any path it can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n) of one text file, n from 0 in its order.

    A file's lines come as one row each with their partition and place in it; the partitions' sizes, one number each,
    turn that into the place in the file.
    """
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    parts = lines.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("p", before.alias("before"))
    return lines.withColumn("p", F.shiftright("id", 33)).join(starts, "p").select(F.col("value").alias("line"), (F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("n"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with repeated names told apart by .1, .2 ... in order."""
    again = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("__again", again).withColumn(name, F.when(F.col("__again") > 0, F.concat_ws(".", name, F.col("__again").cast("string"))).otherwise(F.col(name))).drop("__again")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def sample_files(spark: SparkSession, folder: str, filtered: bool = True, reference: str | None = None) -> tuple[str, str, str]:
    """(matrix, barcodes, features) of a sample's folder.

    Under it, or under its `outs`, the filtered or raw matrix of either layout is looked for: *_feature_bc_matrix with
    features, or *_gene_bc_matrices with a folder for each reference, which has to be named if there are several; else
    the folder holds the files itself. Files may end in .gz; peaks.bed stands for features.
    """
    found = _names(spark, folder)
    if "outs" in found:
        folder, found = f"{folder}/outs", _names(spark, f"{folder}/outs")
    kind = "filtered" if filtered else "raw"
    if f"{kind}_feature_bc_matrix" in found:
        folder = f"{folder}/{kind}_feature_bc_matrix"
    elif f"{kind}_gene_bc_matrices" in found:
        folder = f"{folder}/{kind}_gene_bc_matrices"
        references = _names(spark, folder)
        if reference is None and len(references) != 1:
            raise ValueError(f"{folder} has the references {', '.join(references) or '(none)'}; name one")
        if reference is not None and reference not in references:
            raise FileNotFoundError(f"{folder} has no reference {reference}")
        folder = f"{folder}/{reference or references[0]}"
    found = set(_names(spark, folder))

    def one(*names: str) -> str:
        for name in names:
            for file in (name, f"{name}.gz"):
                if file in found:
                    return f"{folder}/{file}"
        raise FileNotFoundError(f"{folder} has no {names[0]}")

    return one("matrix.mtx"), one("barcodes.tsv"), one("features.tsv", "genes.tsv", "peaks.bed")


def read_samples(spark: SparkSession, folders: dict[str, str], filtered: bool = True, reference: str | None = None, min_umis: int = 0, num_cells: int | None = None) -> DataFrame:
    """The rows of `read_triplets` of several samples, by name; `sample_files` finds their files."""
    out = None
    for name, folder in folders.items():
        matrix, cells, features = sample_files(spark, folder, filtered, reference)
        one = read_triplets(spark, "", name, min_umis, num_cells, matrix, cells, features)
        out = one if out is None else out.unionByName(one)
    return out


def read_triplets(spark: SparkSession, folder: str, dataset: str, min_umis: int = 0, num_cells: int | None = None, matrix: str = "matrix.mtx", cells: str = "barcodes.tsv", features: str = "features.tsv") -> DataFrame:
    """(dataset, cell, gene, value, feature_type) of a MatrixMarket folder: features by rows, cells by columns.

    Barcodes lose a trailing -1; features take their second column as name, made unique, and the third as type (null
    without one); regions of a bed file are named chrom:start-end. Cells with min_umis counts or fewer go; with
    num_cells, so do all but the largest. Without a folder, the names are whole paths.
    """
    place = (lambda name: f"{folder}/{name}") if folder else (lambda name: name)
    triple = F.split(F.trim("line"), r"\s+")
    lines = numbered_lines(spark, place(matrix)).where("NOT startswith(line, '%') AND trim(line) != ''")
    sizes = lines.agg(F.min("n")).first()[0]  # the first line that is no comment holds the sizes
    entries = lines.where(F.col("n") > (-1 if sizes is None else sizes)).select(*[triple[i].cast("long").alias(c) for i, c in enumerate(("row", "column", "value"))])
    f = F.split("line", "\t")
    bed = features.removesuffix(".gz").endswith(".bed")
    name = F.concat(f[0], F.lit(":"), f[1], F.lit("-"), f[2]) if bed else F.coalesce(F.try_element_at(f, F.lit(2)), f[0])
    kind = F.lit("Chromatin Accessibility") if bed else F.try_element_at(f, F.lit(3))
    names = numbered_lines(spark, place(features)).select((F.col("n") + 1).alias("row"), name.alias("gene"), kind.alias("feature_type"))
    barcodes = numbered_lines(spark, place(cells)).select((F.col("n") + 1).alias("column"), F.regexp_replace("line", "-1$", "").alias("cell"))
    joined = entries.join(unique_names(names, "gene", "row"), "row").join(barcodes, "column").select(F.lit(dataset).alias("dataset"), "cell", "gene", "value", "feature_type")
    totals = joined.groupBy("cell").agg(F.sum("value").alias("total")).where(F.col("total") > min_umis)
    if num_cells is not None:
        totals = totals.orderBy(F.desc("total"), "cell").limit(num_cells)
    return joined.join(totals.select("cell"), "cell", "left_semi").select("dataset", "cell", "gene", "value", "feature_type")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(cell, in_tissue, array_row, array_col, pxl_row, pxl_col) of a positions file without a header."""
    return spark.read.schema("cell string, in_tissue int, array_row int, array_col int, pxl_row int, pxl_col int").csv(path)


def placed(cells: DataFrame, positions: DataFrame, scale: float, height: float) -> DataFrame:
    """cells with their place in a scaled image whose y axis points up: x = column * scale, y = height - row * scale."""
    return cells.join(positions.withColumn("cell", F.regexp_replace("cell", "-1$", "")), "cell", "left").withColumn("x", F.col("pxl_col") * scale).withColumn("y", height - F.col("pxl_row") * scale)


def read_scale_factors(spark: SparkSession, path: str) -> dict:
    return spark.read.option("multiLine", True).json(path).first().asDict()


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(gene, barcodes): columns 4 and 7 of a BED-like file without a header."""
    row = F.split("value", "\t")
    return spark.read.text(path).select(F.try_element_at(row, F.lit(4)).alias("gene"), F.try_element_at(row, F.lit(7)).alias("barcodes"))


def fragment_counts(fragments: DataFrame) -> DataFrame:
    """(cell, gene, value): how often a barcode stands in a gene's ;-separated lists; null lists count nothing."""
    return fragments.select("gene", F.explode(F.split("barcodes", ";")).alias("cell")).where("cell != ''").groupBy("cell", "gene").agg(F.count("*").alias("value"))


def feature_matrix(genes: DataFrame, promoters: DataFrame, threshold: int = 0, separate: bool = False):
    """Counts over gene bodies of barcodes with more than threshold there, with those over promoters added; or both, separate."""
    body, front = fragment_counts(genes), fragment_counts(promoters)
    alive = body.groupBy("cell").agg(F.sum("value").alias("n")).where(F.col("n") > threshold).select("cell")
    body, front = body.join(alive, "cell", "left_semi"), front.join(alive, "cell", "left_semi")
    if separate:
        return body, front
    return body.unionByName(front).groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def read_ic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("go string, ic double, frequency double").option("sep", "\t").option("comment", "#").csv(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("go string, parent string").option("sep", "\t").option("comment", "#").csv(path)


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms: go, name, namespace, obsolete; alternatives: alt, go) of an OBO file's [Term] stanzas.

    alternatives has each alternative id with its term's, and each obsolete id with those to consider in its place.
    """
    stanza = spark.read.option("lineSep", "\n\n").text(path).where("startswith(trim(value), '[Term]')")
    one = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: (.*?)\s*$", 1)
    every = lambda tag: F.explode(F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: (\S+)"), F.lit(1)))
    obsolete = one("is_obsolete") == "true"
    terms = stanza.select(one("id").alias("go"), one("name").alias("name"), one("namespace").alias("namespace"), obsolete.alias("obsolete"))
    other = stanza.select(every("alt_id").alias("alt"), one("id").alias("go"))
    instead = stanza.where(obsolete).select(one("id").alias("alt"), every("consider").alias("go"))
    return terms, other.unionByName(instead)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, by dataset where it has one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("dataset") if "dataset" in df.columns else writer).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
