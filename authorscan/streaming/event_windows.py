"""Windowed detection over an event stream (X2): event time, watermark, late data.

A user's events of one tumbling window are a "document": each event's value gets a p-value from the frozen null
distribution of its event type, and the window is tested with the same operator as a document. The state holds counts of
distinct p-values per (window, user), not events; a window leaves it, complete, once the watermark has passed
its end. Events later than that are dropped by Spark.

Cross-fitted: the null of a user comes from the users of the other parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.operators.detect import document_tests
from authorscan.operators.survival import fit_null_grid, grid_pvalue
from authorscan.params import Params

NULL_KEYS = ["half", "event_type"]
P_DECIMALS = 9  # p-values are rounded, so that equal ones are counted together


def event_null_grid(events: DataFrame, params: Params) -> DataFrame:
    """The null distribution of the values of every event type, for the users of each half."""
    null = events.select((1 - F.pmod("user_id", F.lit(2))).alias("half"), "event_type", F.lit(1).alias("length"), F.col("value").alias("x"))
    return fit_null_grid(null.dropna(), params, NULL_KEYS)


def event_pvalues(events: DataFrame, grid: DataFrame) -> DataFrame:
    """``ts, user_id, pvalue`` of the events that have one (a stream or a table; the grid is a table)."""
    e = events.select("ts", "user_id", "event_type", F.col("value").alias("response"), F.pmod("user_id", F.lit(2)).alias("half"), F.lit(1).alias("eff_length"))
    return (grid_pvalue(e, grid, NULL_KEYS, lengths=(1, 1)).filter(F.col("pvalue").isNotNull())
            .select("ts", "user_id", F.round("pvalue", P_DECIMALS).alias("pvalue")))


def window_counts(pvalues: DataFrame, size: str = "1 day") -> DataFrame:
    """``window, user_id, pvalue, n``: the events of each window by p-value."""
    return pvalues.groupBy(F.window("ts", size), "user_id", "pvalue").agg(F.count(F.lit(1)).alias("n"))


def window_tests(counts: DataFrame, params: Params) -> DataFrame:
    """HC, Fisher, minP, Bonferroni of every (window, user)."""
    rows = counts.select(F.col("window.start").alias("window_start"), "user_id", "pvalue", "n")
    return document_tests(rows, ["window_start", "user_id"], params, weight_col="n")


def start_event_stream(stream: DataFrame, grid: DataFrame, params: Params, sink_path: str, checkpoint: str,
                       size: str = "1 day", delay: str = "1 hour"):
    """Test every window once it is complete; a replayed micro-batch replaces its own folder.

    Event time without a zone (``TIMESTAMP_NTZ``) is taken as UTC for the watermark, and a window's start is given back without one.
    """
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    zoned = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {epoch}, ts))")
    plain = F.expr(f"timestampadd(MICROSECOND, unix_micros(window.start), {epoch})")

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = batch.withColumn("window", F.struct(plain.alias("start")))
        window_tests(counts, params).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    counts = window_counts(event_pvalues(stream, grid).withColumn("ts", zoned).withWatermark("ts", delay), size)
    return (counts.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
