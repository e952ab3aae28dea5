"""Connected components by contraction: every node hooks to its smallest neighbour, chains are shortened
by pointer jumping, and the edges are redrawn between what is left. Tables are written after each step, so
a join reads stored tables on both sides and Spark can split a hub's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.llm.blocks import store


def _relabel(df: DataFrame, col: str, parent: DataFrame) -> DataFrame:
    p = parent.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
    return df.join(p, df[col] == p["__n"], "left").withColumn(col, F.coalesce("__u", col)).drop("__n", "__u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of its component."""
    left = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        parent = store(both.groupBy("node").agg(F.min("other").alias("up")).withColumn("up", F.least("node", "up")))
        while True:
            jumped = _relabel(parent.withColumn("was", F.col("up")), "up", parent)
            jumped = store(jumped)
            if jumped.where("up <> was").isEmpty():
                break
            parent = jumped.drop("was")
        steps.append(parent)
        for c in ("a", "b"):
            left = _relabel(left, c, parent)
        left = store(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("up").alias("root"))
    for parent in steps[1:]:
        out = _relabel(out, "root", parent)
    return out
