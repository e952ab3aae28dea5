"""Sinks (S11 S12 S13 S15): result tables. Stage outputs of a run (S14) are in ``runs.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result table (accuracy, power, logistic regression) as CSV with a
    header, or Parquet. A report has one row per topic x ratio x statistic; as CSV it
    is one file, since that is how it is read."""
    w = df.coalesce(1).write.mode("overwrite") if fmt == "csv" else df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_hc_null(hc_null: DataFrame, path: str) -> None:
    """HC null table with ``gamma`` / ``variant`` as columns (filter on read).
    A second run replaces the (variant, gamma) partitions it writes and leaves the others."""
    (hc_null.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("variant", "gamma").parquet(path))


def read_hc_null(spark: SparkSession, path: str, variant: str, gamma: float) -> DataFrame:
    """S15 (reload): the stored null table of one parameter pair; only its partition is read. None stored is an error."""
    rows = spark.read.option("basePath", path).parquet(path).filter(
        (F.col("variant").cast("string") == variant) & (F.col("gamma").cast("double") == float(gamma)))
    if rows.isEmpty():
        raise ValueError(f"no HC null table for variant {variant} and gamma {gamma} under {path}")
    return rows.withColumn("variant", F.lit(variant)).withColumn("gamma", F.lit(float(gamma)))
