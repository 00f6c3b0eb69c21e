"""The folder that driver and executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the driver ends."""
    where = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def local_path(path: str) -> str:
    """A path of the shared folder as tasks open it by themselves; an error where only Spark's readers could."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} can't be opened as a file")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again. The table is removed when the driver ends."""
    spark = df.sparkSession
    where = place(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
