"""Ordered per-key computations that stay parallel inside one key.

A plain window puts a whole key into one task. Here the key is cut into order-preserving
buckets: each bucket is summarised with map-side combine, the (few) summaries are scanned
per key, and the result is joined back to rows windowed per (key, bucket). `bucket` must
be non-decreasing in the first order column.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_B = "_bucket"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint directory. Without one only a local master gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/profilelab-{uuid.uuid4().hex}"


def small_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Mark a vocabulary-like table for broadcast after measuring it; a larger one is left to Spark's planner."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back, so that later branches neither recompute it nor
    lose it with an executor. Used where a result feeds several dependent passes. Nothing reads the shuffles of the
    pass again, so their files go with its end and do not wait for the driver's garbage collection."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what `settled` wrote for `df`, which no later pass reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys; the right side keeps only its other columns."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rn") -> DataFrame:
    """Exact row_number over (keys, order)."""
    b = df.withColumn(_B, bucket)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (b.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    local = F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order))
    return (_null_safe(b, sizes, [*keys, _B]).withColumn(name, (local + F.col("_off")).cast("long"))
            .drop(_B, "_off"))


def carried(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str,
            name: str) -> DataFrame:
    """Last non-null `value` at or before each row over (keys, order)."""
    b = df.withColumn(_B, bucket)
    rank = F.struct(*order)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    sums = (b.groupBy(*keys, _B).agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("_last"))
            .withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last"))
    inside = F.last(value, ignorenulls=True).over(
        Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (_null_safe(b, sums, [*keys, _B]).withColumn(name, F.coalesce(inside, F.col("_carry")))
            .drop(_B, "_carry"))


def summed_before(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str,
                  name: str) -> DataFrame:
    """Sum of `value` over the rows strictly before each row."""
    b = df.withColumn(_B, bucket)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    sums = (b.groupBy(*keys, _B).agg(F.sum(value).alias("_s"))
            .withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    inside = F.sum(value).over(
        Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (_null_safe(b, sums, [*keys, _B])
            .withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_off")).drop(_B, "_off"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: list[str], how: str = "inner",
                counts: DataFrame | None = None, rows_per_task: int = 500_000) -> DataFrame:
    """Equi-join (inner, left or left_semi) that splits only the keys that need it.

    Keys with more than `rows_per_task` rows in `counts` (a cheap table with the keys of `big`; default `big`) are
    measured first; their rows are spread over ceil(rows / rows_per_task) salts and the matching rows of `small`
    repeated as often. All other keys join unsalted, so `small` hardly grows. The list of hot keys is broadcast while it
    is counted as short, and joined by a shuffle beyond.
    """
    sizes = (big if counts is None else counts).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    hot = sizes.where(F.col("_c") > rows_per_task).select(*keys, F.ceil(F.col("_c") / rows_per_task).cast("int").alias("_salts"))
    found = hot.limit(10_001).collect()  # a bounded look; a longer list stays a table
    if not found:
        return big.join(small, keys, how)
    if len(found) <= 10_000:
        hot = F.broadcast(big.sparkSession.createDataFrame(found, hot.schema))
    n = F.coalesce("_salts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_on), n).cast("int")).drop("_salts")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


# Kinds of keys whose equal values have equal hashes, and a hash that needs no look at the collation.
_HASHED_KINDS = ("boolean", "tinyint", "smallint", "int", "bigint", "string", "date", "timestamp")
_WEIGHT_BUCKETS = 4096


def _weight_bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_WEIGHT_BUCKETS))


def key_weights(frames: list[DataFrame]) -> list[dict[int, int] | None]:
    """Rows of each frame by hash bucket of all its columns, found in one job; None for columns that can't be hashed safely.
    The number of buckets is fixed, so neither tasks nor the driver hold keys."""
    sure = [i for i, df in enumerate(frames) if all(kind in _HASHED_KINDS for _, kind in df.dtypes)]
    out: list[dict[int, int] | None] = [{} if i in sure else None for i in range(len(frames))]
    counts = [frames[i].groupBy(_weight_bucket(frames[i].columns).alias("b")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "b", "n") for i in sure]
    for r in reduce(DataFrame.unionByName, counts).collect() if counts else []:
        out[r.i][r.b] = r.n
    return out


def even_parts(weights: dict[int, int], keys: list[str], rows_per_task: int) -> tuple[int, Column, Column | None]:
    """(parts, cold, hot): into how many parts rows are dealt by `keys` to have about `rows_per_task` each, a test on `keys` for
    the rows to deal, and one for those of frequent keys (None if there are none)."""
    hot = [b for b, n in weights.items() if n > rows_per_task]
    is_hot = _weight_bucket(keys).isin(hot)
    return max(1, -(-sum(weights.values()) // rows_per_task)), ~is_hot if hot else F.lit(True), is_hot if hot else None
