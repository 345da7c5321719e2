"""The parallel ordered computations must equal plain windows, with one key holding most rows."""

import random
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from profilelab.operators import ordered as O


def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.random() < 0.1, rng.randrange(9)) for i in range(3000)]
    data += [(None, 5000 + i, i % 4 == 0, 1) for i in range(20)]
    return spark.createDataFrame(data, "k string, pos int, flag boolean, n int").withColumn("v", F.when(F.col("flag"), F.col("n")))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ranked(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("pos")
    got = O.ranked(df, ["k"], [F.col("pos")], F.floor(F.col("pos") / 50))
    same(got, df.withColumn("rn", F.row_number().over(w).cast("long")).select(got.columns))


def test_carried(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    got = O.carried(df, ["k"], [F.col("pos")], F.floor(F.col("pos") / 50), "v", "x")
    same(got, df.withColumn("x", F.last("v", ignorenulls=True).over(w)).select(got.columns))


def test_summed_before(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    got = O.summed_before(df, ["k"], [F.col("pos")], F.floor(F.col("pos") / 50), "n", "x")
    same(got, df.withColumn("x", F.coalesce(F.sum("n").over(w), F.lit(0))).select(got.columns))


def test_salted_join_spreads_a_hot_key(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), F.col("id"))
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for per_task in (10, 10_000):  # split into 100 salts, and not at all
        out = O.salted_join(big, small, ["k"], ["id"], rows_per_task=per_task)
        assert out.count() == 1000 and set(out.columns) == {"k", "id", "v"}
        lone = big.withColumn("k", F.lit(3))
        assert O.salted_join(lone, small, ["k"], ["id"], "left", rows_per_task=per_task).where("v is null").count() == 1000
        assert O.salted_join(big, small, ["k"], ["id"], "left_semi", rows_per_task=per_task).count() == 1000


def test_small_side_measures_before_broadcasting(spark):
    df = spark.range(100).toDF("x")
    assert "broadcast" in O.small_side(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in O.small_side(df, max_rows=10)._jdf.queryExecution().logical().toString().lower()


def test_settled_uses_the_shared_folder(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("profilelab-*"))
    assert O.settled(spark.range(5)).count() == 5
    assert len(set(shared.glob("profilelab-*")) - before) == 1


def test_settled_leaves_no_shuffle_files(spark):
    import time

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(O._CLEANUP, None)
    df = spark.range(20_000).groupBy((F.col("id") % 7_001).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(5, "n", "k")
    kept = O.settled(df)
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(O._CLEANUP, None) == setting
    assert kept.count() == 7_001 and kept.count() == df.count()  # the rows stay, and so does the way to make them
    O.dropped(kept)
    assert not Path(kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]).exists()
