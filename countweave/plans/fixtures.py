"""Count matrices out of the supplied tables, in the engine's long form (dataset, cell, gene, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


def lineitem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets are return flags, cells suppliers, genes a part's brand and size, values whole quantities."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_suppkey", "l_partkey", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(":", "p_brand", "p_size").alias("gene"))
    n = lines.count()
    if n > session.ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):  # else the join's tasks would grow with the table
        lines = session.dealt(lines, n, "l_partkey")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    named = joined.select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").cast("string").alias("cell"), "gene", "l_quantity")
    key = ["dataset", "cell", "gene"]
    return session.dealt(named, n, *key).groupBy(*key).agg(F.sum("l_quantity").cast("bigint").alias("value"))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets are languages, cells documents, genes the first three letters of words, values their counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "doc_id", "text")
    words = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("cell"), F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w != ''")
    return words.groupBy("dataset", "cell", F.substring("w", 1, 3).alias("gene")).agg(F.count("*").alias("value"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets are event types, cells users, genes hours of the day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "ts")
    return events.groupBy(F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("cell"), F.hour("ts").cast("string").alias("gene")).agg(F.count("*").alias("value"))


#: The same in SQL, as the head of a WITH clause.
LINEITEM_SQL = """counts AS MATERIALIZED (
  SELECT l_returnflag AS dataset, l_suppkey::VARCHAR AS cell, p_brand || ':' || p_size AS gene, sum(l_quantity)::BIGINT AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""
EVENTS_SQL = """counts AS (
  SELECT event_type AS dataset, user_id::VARCHAR AS cell, hour(ts)::VARCHAR AS gene, count(*) AS value FROM events GROUP BY ALL
)"""
