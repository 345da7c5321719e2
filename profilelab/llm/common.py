"""Tables written once to the shared folder, and a few helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Without that setting only a local master gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str | None = None) -> str:
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written once and read back: later passes neither recompute them nor lose them with an executor."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete what `staged` wrote for `df`."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def released(spark: SparkSession, share: float = 0.5) -> None:
    """Between passes: a driver whose heap has grown beyond this share of what it may take collects its garbage, which gives
    the memory back and lets go of the broadcasts and shuffles of finished passes. With room enough it does nothing."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, other letters as they are. Text of single bytes takes the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
