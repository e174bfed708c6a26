"""Lineage is cut with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task that adds up groups of about one row.
ROWS = 500_000
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of this machine if Spark runs on it alone, as in tests, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="countweave-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor then costs no more than one step."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, what)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the table stands for the shuffle files of this step
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, before a groupBy of them that leaves about as many rows as there are: in so many tasks that each has about ROWS, however many rows there are, and without a first sum in the tasks that read."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)
