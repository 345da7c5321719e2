"""Tables of Spark's own Parquet writer.

Snapshots overwrite a folder, appends add files to it. A store is laid out by hash of its owner, so a merge reads and
replaces the folders of the owners it touches and no others (dynamic partition overwrite). Spark replaces folders at the
commit of a write, one after the other: one writer at a time, and readers between writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from profilelab.functions import text as t

PARTS = 256


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                rows_per_file: int = 2_000_000) -> None:
    """Write a snapshot ('overwrite') or add rows ('append')."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def part_of(owner, parts: int = PARTS) -> Column:
    """The folder of an owner."""
    return F.pmod(F.xxhash64(t.col(owner).cast("string")), F.lit(parts)).cast("int")


def write_store(rows: DataFrame, path: str, parts: int = PARTS, owner: str = "user_id", spread: str = "chunk_id", rows_per_file: int = 2_000_000) -> None:
    """Replace the folders of the owners in `rows`; other folders keep their files.

    Rows are cut into ranges of (folder, hash), so folders have few files and a busy owner's folder is written by many tasks.
    """
    placed = rows.withColumn("part", part_of(owner, parts)).repartitionByRange("part", F.xxhash64(spread))
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
     .partitionBy("part").parquet(path))


def read_store(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None, parts: int = PARTS, owner: str = "user_id") -> DataFrame:
    """Rows of the store, or of some folders of it. A store written with another number of folders raises."""
    rows = spark.read.schema(StructType([*schema.fields]).add("part", IntegerType())).parquet(path)
    if only is not None:
        rows = rows.where(F.col("part").isin(only))
    wrong = F.col("part") != part_of(owner, parts)
    checked = F.when(wrong, F.raise_error(F.lit(f"the store has not {parts} parts")).cast(schema[owner].dataType)).otherwise(F.col(owner))
    return rows.withColumn(owner, checked).select(*schema.names)
