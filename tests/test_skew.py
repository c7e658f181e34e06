import random

from pyspark.sql import Window as W, functions as F

from vouchline.skew import block, hot_keys, islands, ordered


def _rows(spark):
    rng = random.Random(5)
    rows = [(k, pos, rng.randint(-5, 9), rng.choice([None, 1, 2])) for k, n in [("a", 40), ("b", 2), ("c", 17), ("d", 1)] for pos in range(0, 2 * n, 2)]
    return spark.createDataFrame(rows, "k string, pos long, v int, w int").repartition(5)


def test_split_windows_equal_plain_windows(spark, all_hot):
    df = _rows(spark)
    got = ordered(df, ["k"], ["pos"], block("pos"), running={"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "b": ("max_before", F.col("v"))},
                  lags={"pv": "v", "pw": "w"})
    w = W.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.max("v").over(before).alias("b"),
                     F.lag("v").over(w).alias("pv"), F.lag("w").over(w).alias("pw"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert hot_keys(df, ["k"]).count() == 2


def test_split_islands_equal_plain_islands(spark, all_hot):
    df = _rows(spark)
    got = islands(df, ["k"], ["pos"], block("pos"), "v", lambda before: F.abs(F.col("v") - before) > 3, "run")
    w = W.partitionBy("k").orderBy("pos")
    opens = F.when(F.lag("v").over(w).isNull() | (F.abs(F.col("v") - F.lag("v").over(w)) > 3), 1).otherwise(0)
    want = df.withColumn("o", opens).withColumn("run", F.sum("o").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("o")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
