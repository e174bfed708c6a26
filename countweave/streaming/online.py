"""Structured Streaming over arriving counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import session
from ..operators.factorize import Factors, online, project, restored, stored


def read_counts(spark: SparkSession, folder: str, schema: str = "dataset string, cell string, gene string, value long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window, dataset, cell, gene, value) by event time; later than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "dataset", "cell", "gene").agg(F.sum("value").alias("value"))


def running_cell_metrics(stream: DataFrame) -> DataFrame:
    """(dataset, cell, n_umi, n_entries) of all that has arrived."""
    return stream.groupBy("dataset", "cell").agg(F.sum("value").alias("n_umi"), F.count("*").alias("n_entries"))


def project_stream(rows: DataFrame, f: Factors, folder: str, checkpoint: str) -> StreamingQuery:
    """H of arriving cells (dataset, cell, genes, values) at fixed loadings, appended as Parquet; each cell for itself, without state."""
    return project(rows, f).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_by_day(stream: DataFrame, folder: str, checkpoint: str, time: str = "ts", kind: str = "event_type", value: str = "value") -> StreamingQuery:
    """(day, kind, n, total) of all that arrives, in whole after each batch as Parquet."""
    daily = stream.groupBy(F.to_date(time).alias("day"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return daily.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches whose state is in the folder, in order."""
    try:
        return sorted(r[0] for r in spark.read.parquet(folder).select(F.col("version").cast("long")).distinct().collect())
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing is committed yet
            return []
        raise


def state_at(spark: SparkSession, folder: str, version: int) -> Factors:
    return restored(spark, f"{folder}/version={version}")


def refiner(genes: list[str], k: int, folder: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **how) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: the model of the batches before it is refined with its cells and stored under its number.

    A batch only reads states of smaller numbers and replaces its own, which becomes visible when it is written whole.
    So a batch that comes again after a failure does what it did, and no batch is counted twice. prepare makes rows
    (dataset, cell, genes, values) of what arrives; an empty batch leaves no state. how: see `online`.
    """

    def refine(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = session.cut(prepare(batch) if prepare else batch, "arrived")
        if rows.isEmpty():
            return
        before = [v for v in versions(spark, folder) if v < number]
        start = state_at(spark, folder, before[-1]) if before else None
        stored(online(rows, genes, k, start=start, **how), f"{folder}/version={number}", spark)

    return refine


def refine_stream(arriving: DataFrame, genes: list[str], k: int, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **how) -> StreamingQuery:
    """Online factorization that goes on with every batch that arrives: new datasets join, known ones go on from their sums. The states are in `folder` by version (`versions`, `state_at`)."""
    return arriving.writeStream.foreachBatch(refiner(genes, k, folder, prepare, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_gene_moments(stream: DataFrame) -> DataFrame:
    """(dataset, gene, gene_sum, gene_sum_sq, n_cell) of all that has arrived."""
    return stream.groupBy("dataset", "gene").agg(F.sum("value").alias("gene_sum"), F.sum(F.col("value") * F.col("value")).alias("gene_sum_sq"), F.count("*").alias("n_cell"))


def kept_whole(running: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A running aggregate, whole after each batch, under the batch's number: a batch that comes again replaces its own."""
    return running.writeStream.outputMode("complete").foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/version={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last version in a folder."""
    return spark.read.parquet(f"{folder}/version={versions(spark, folder)[-1]}")
