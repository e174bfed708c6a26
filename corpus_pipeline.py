"""A training corpus out of `documents`: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from countweave.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy rejects."""
    return quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest id; rows without an id are compared too and come last.

    Rows are told apart by a number of their own, so repeated rows are a group, and texts under one id are not.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.join(rows.select("__row", "text"), key="__row").select("__row", "component_id")
    facts = rows.select("__row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("place"))
    members = cut(groups.join(facts, "__row"), "members")
    first = members.groupBy("component_id").agg(F.min("place").alias("place")).select("place.__row")
    return rows.join(members.join(first, "__row", "left_anti").select("__row"), "__row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of 50 words or more that stand elsewhere too; documents of which no word is left go."""
    passage = suffix_dedup.PASSAGE
    stripped = suffix_dedup.strip(docs.select(*COLUMNS), length=passage[0], passage=passage)
    some = F.col("clean_text").isNull() | F.col("clean_text").rlike(r"[^ \x09-\x0D]")
    left = stripped.where(some).withColumn("text", F.coalesce("clean_text", "text"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, in random order."""
    return mixing.replicate(docs).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    packed = packing.pack(docs.select("doc_id", "text"), paths=paths)
    return packed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mix),
    ("best-fit packing", sequences),
]

#: Packing has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
