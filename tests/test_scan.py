from pyspark.sql import Window
from pyspark.sql import functions as F

from authorscan.operators.scan import Acc, row_index, scan


def _frame_ref(df, frame):
    w = Window.partitionBy("k").orderBy("x")
    lo, hi = {"upto": (Window.unboundedPreceding, 0), "before": (Window.unboundedPreceding, -1),
              "from": (0, Window.unboundedFollowing), "after": (1, Window.unboundedFollowing)}[frame]
    return w.rowsBetween(lo, hi)


def test_scan_matches_window_with_hot_key(spark):
    # key 0 holds about half the rows and spans several range partitions
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("k"),
        F.col("id").alias("x"),
        (F.col("id") % 7).cast("double").alias("v"),
    )
    accs = [Acc(f"{fn}_{fr}", fn, "v", fr) for fn in ("sum", "max", "min")
            for fr in ("upto", "before", "from", "after")]
    got = scan(df, ["k"], ["x"], accs, num_partitions=7)
    ref = df.withColumns({f"{fn}_{fr}": getattr(F, fn)("v").over(_frame_ref(df, fr))
                          for fn in ("sum", "max", "min") for fr in ("upto", "before", "from", "after")})
    cols = ["k", "x"] + [a.out for a in accs]
    assert got.select(cols).exceptAll(ref.select(cols)).count() == 0
    assert ref.select(cols).exceptAll(got.select(cols)).count() == 0


def test_row_index_dense(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 500).alias("x"))
    got = row_index(df, ["k"], ["x"], "i", num_partitions=5)
    ref = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("x")) - 1)
    assert got.select("k", "x", "i").exceptAll(ref.select("k", "x", "i")).count() == 0
