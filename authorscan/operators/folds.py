"""k-fold roles (W4 W5 W6 J5 W8) and the seeded shuffled split.

Articles keep their file order inside a group (topic x edit ratio). Blocks are
contiguous; for every fold a block is ``test`` (the fold's block and, with a
window > 1, the first window-1 other blocks) or ``null``. Inside the null part
the first floor(train_split * n_null) rows (in file order) fit the null
distribution, the rest are ``calibration`` rows.

Roles are decided on a tiny per-(group, fold, block) table; rows then get their
role from one equi join on (group, block) — the row index inside a group comes
from a skew-safe scan, never from a window over a whole topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorscan.operators.scan import Acc, scan
from authorscan.params import Params


def indexed(df: DataFrame, group_keys, order) -> DataFrame:
    """Dense 0-based ``row_index`` and group size ``n_rows`` (skew-safe)."""
    s = scan(df, list(group_keys), list(order), [Acc("row_index", "sum", F.lit(1), "before"),
                                                 Acc("n_rows", "sum", F.lit(1), "all")])
    return (s.withColumn("row_index", F.coalesce("row_index", F.lit(0)).cast("long"))
            .withColumn("n_rows", F.col("n_rows").cast("long")))


def block_table(groups: DataFrame, params: Params, group_keys) -> DataFrame:
    """Per (group, fold, block): ``test`` flag, rows in the block, test rows before it,
    null rows of the fold and the null/calibration cut. ``groups``: ``group_keys, n_rows``."""
    k, win = int(params.k_folds), int(params.window_size)
    keys = list(group_keys)
    n = F.col("n_rows")
    if params.parity:
        w = F.floor(n / k)
        g = groups.withColumn("_w", w).filter(F.col("_w") > 0).withColumn(
            "n_blocks", (F.ceil(n / F.col("_w")) - 1).cast("int"))
        size = F.col("_w")
    else:
        g = groups.withColumn("n_blocks", F.lit(k))
        size = (F.floor(((F.col("block") + 1) * n + (k - 1)) / k)
                - F.floor((F.col("block") * n + (k - 1)) / k))
    t = (g.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 1, F.lit(0)))))
         .filter(F.col("block") < F.col("n_blocks"))
         .withColumn("block_rows", size.cast("long")))
    r = F.col("block") - F.when(F.col("block") > F.col("fold"), 1).otherwise(0)
    t = t.withColumn("is_test", (F.col("block") == F.col("fold")) | (r < win - 1))
    wb = Window.partitionBy(*keys, "fold").orderBy("block")  # <= k rows per partition
    t = (t.withColumn("test_before", F.coalesce(F.sum(F.when(F.col("is_test"), F.col("block_rows"))).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("n_null", F.coalesce(F.sum(F.when(~F.col("is_test"), F.col("block_rows"))).over(
             Window.partitionBy(*keys, "fold")), F.lit(0)))
         .withColumn("cut", F.floor(F.col("n_null") * F.lit(float(params.train_split))).cast("long")))
    return t.select(*keys, "fold", "block", "is_test", "block_rows", "test_before", "n_null", "cut")


def fold_roles(articles: DataFrame, params: Params, group_keys=("topic",), order=("doc_id",)) -> DataFrame:
    """One row per (article, fold) with ``role`` test / null / calibration.

    Default: ``block = floor(row_index * k / n)`` (all rows used, k blocks).
    ``params.parity``: width floor(n/k), ``ceil(n/width) - 1`` blocks, trailing rows
    unused, groups with fewer than k rows skipped — the published slicing.
    """
    keys = list(group_keys)
    k = int(params.k_folds)
    idx = indexed(articles, keys, order)
    groups = idx.select(*keys, "n_rows").distinct()
    bt = block_table(groups, params, keys)
    if params.parity:
        block = F.floor(F.try_divide(F.col("row_index"), F.floor(F.col("n_rows") / k)))  # NULL: fewer than k rows
    else:
        block = F.floor(F.col("row_index") * k / F.col("n_rows"))
    rows = idx.withColumn("block", block.cast("int"))
    j = rows.join(bt, [*keys, "block"])  # small table: AQE broadcasts it when it is small
    null_rank = F.col("row_index") - F.col("test_before")
    role = (F.when(F.col("is_test"), F.lit("test"))
            .when(null_rank < F.col("cut"), F.lit("null"))
            .otherwise(F.lit("calibration")))
    return j.withColumn("role", role).drop("is_test", "block_rows", "test_before", "n_null", "cut")


def fold_segments(articles: DataFrame, params: Params, group_keys=("topic",),
                  order=("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """W4 W5 W6 J5 without a row per (article, fold): ``(docs, roles)``.

    A block is cut where the null part of some fold ends, so all articles of a segment share their role in every fold.
    ``docs``: the articles with ``segment``; ``roles``: ``group_keys, segment, fold, role``, whose size depends on
    k alone (at most k blocks of k + 1 segments in k folds). ``docs`` joined with ``roles`` equals :func:`fold_roles`.
    """
    keys = list(group_keys)
    k = int(params.k_folds)
    idx = indexed(articles, keys, order)
    bt = block_table(idx.select(*keys, "n_rows").distinct(), params, keys)
    bt = bt.withColumn("_end", F.when(~F.col("is_test"), F.col("test_before") + F.col("cut")))
    ends = bt.groupBy(*keys, "block").agg(F.array_sort(F.collect_set("_end")).alias("_ends"))  # at most k of them
    block = (F.floor(F.try_divide(F.col("row_index"), F.floor(F.col("n_rows") / k))) if params.parity
             else F.floor(F.col("row_index") * k / F.col("n_rows"))).cast("int")
    number = F.col("block") * (k + 1)
    docs = (idx.withColumn("block", block).join(ends, [*keys, "block"])
            .withColumn("segment", (number + F.size(F.filter("_ends", lambda e: e <= F.col("row_index")))).cast("int"))
            .drop("_ends", "block"))
    roles = (bt.join(ends, [*keys, "block"])
             .withColumn("_s", F.explode(F.sequence(F.lit(0), F.size("_ends")))))
    role = (F.when(F.col("is_test"), "test")
            .when(F.col("_s") < F.array_position("_ends", F.col("_end")), "null").otherwise("calibration"))
    return docs, roles.select(*keys, (number + F.col("_s")).cast("int").alias("segment"), "fold", role.alias("role"))


def shuffled_split(df: DataFrame, group_keys, id_col: str, seed: int, split: float,
                   out: str = "part") -> DataFrame:
    """Seeded shuffle then an 80/20 prefix split.

    The shuffle order is ``md5(id || '|' || seed)``: stable under repartitioning and
    computable by any SQL engine. First floor(split * n) rows -> ``train``,
    the rest -> ``validation``. Adds ``shuffle_rank``.
    """
    keys = list(group_keys)
    h = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))))
    idx = indexed(h, keys, ["_h", id_col])
    cut = F.floor(F.col("n_rows") * F.lit(float(split)))
    return (idx.withColumn(out, F.when(F.col("row_index") < cut, F.lit("train")).otherwise(F.lit("validation")))
            .withColumnRenamed("row_index", "shuffle_rank").drop("_h"))


def parity_eval_split(doc_scores: DataFrame, params: Params, data_length, keys=("topic", "fold")) -> DataFrame:
    """W8 with ``parity``: the first floor(n/k) results of a fold by *string* order
    of ``name`` are test rows, the rest calibration (the published quirk)."""
    ks = list(keys)
    idx = indexed(doc_scores, ks, ["name"])
    limit = F.floor(F.lit(data_length) / params.k_folds) if isinstance(data_length, int) else \
        F.floor(F.col(data_length) / params.k_folds)
    return idx.withColumn("eval_role", F.when(F.col("row_index") < limit, F.lit("test"))
                          .otherwise(F.lit("calibration")))
