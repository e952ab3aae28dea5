"""Evaluation: confusion counts, rates, ROC / AUC / Youden, threshold calibration,
null-only thresholds and power (A13-A25, T10, T12, J7).

The ROC needs running sums over thresholds inside one experiment key; they come
from the skew-safe scan over pre-aggregated distinct scores. Threshold sweeps
(steps of 0.01 / 0.1) bucket every score once instead of re-scanning all rows for
each threshold, and only the steps at which a count changes become rows of a skew-safe
scan: a range of any number of steps costs no more than the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.operators.scan import Acc, scan


def binary_metrics(df: DataFrame, y: str, yhat: str, keys=(), fpr_zero_if_no_negatives: bool = False) -> DataFrame:
    """TP FN FP TN (always four cells), TPR, FPR, accuracy; NULL on 0/0."""
    ks = list(keys)
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    g = df.groupBy(*ks) if ks else df.groupBy()
    c = g.agg(F.count_if((pp == 1) & (yy == 1)).alias("TP"), F.count_if((pp == 0) & (yy == 1)).alias("FN"),
              F.count_if((pp == 1) & (yy == 0)).alias("FP"), F.count_if((pp == 0) & (yy == 0)).alias("TN"))
    fpr = F.try_divide(F.col("FP").cast("double"), F.col("FP") + F.col("TN"))
    if fpr_zero_if_no_negatives:
        fpr = F.coalesce(fpr, F.lit(0.0))
    return c.select(*ks, "TP", "FN", "FP", "TN",
                    F.try_divide(F.col("TP").cast("double"), F.col("TP") + F.col("FN")).alias("TPR"),
                    fpr.alias("FPR"),
                    F.try_divide((F.col("TP") + F.col("TN")).cast("double"),
                                 F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")).alias("accuracy"))


def roc_curve(df: DataFrame, y: str, score: str, keys=()) -> DataFrame:
    """One row per distinct score (threshold), with TPR / FPR of ``score >= threshold``
    and of the next larger threshold (``tpr_prev``, ``fpr_prev``; 0 at the top).

    Every key of ``df``, also one without a score, has the origin as well: threshold
    infinity, which predicts none, with rates 0."""
    ks = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    yy = F.col(y).cast("long")
    g = (src.filter(F.col(score).isNotNull())
         .groupBy(*ks, F.col(score).cast("double").alias("threshold"))
         .agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg")))
    s = scan(g, ks, ["threshold"], [Acc("tp", "sum", "pos", "from"), Acc("fp", "sum", "neg", "from"),
                                    Acc("tp_after", "sum", "pos", "after"), Acc("fp_after", "sum", "neg", "after"),
                                    Acc("p_before", "sum", "pos", "before"), Acc("n_before", "sum", "neg", "before")])
    P = F.col("tp") + F.coalesce("p_before", F.lit(0))
    N = F.col("fp") + F.coalesce("n_before", F.lit(0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = s.select(*ks, "threshold", "tp", "fp",
                   F.try_divide(F.col("tp").cast("double"), P).alias("tpr"),
                   F.try_divide(F.col("fp").cast("double"), N).alias("fpr"),
                   F.try_divide(z("tp_after").cast("double"), P).alias("tpr_prev"),
                   F.try_divide(z("fp_after").cast("double"), N).alias("fpr_prev"))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    origin = src.select(*ks).distinct().select(
        *ks, F.lit(float("inf")).alias("threshold"), none.alias("tp"), none.alias("fp"),
        *[zero.alias(c) for c in ("tpr", "fpr", "tpr_prev", "fpr_prev")])
    out = out.unionByName(origin)
    return out if keys else out.drop("_all")


def auc(roc: DataFrame, keys=()) -> DataFrame:
    """Trapezoid area under the ROC (origin included)."""
    ks = list(keys)
    area = F.sum((F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2)
    return (roc.groupBy(*ks) if ks else roc.groupBy()).agg(area.alias("auc"))


def youden_threshold(roc: DataFrame, keys=()) -> DataFrame:
    """First maximum of TPR - FPR in descending threshold order, from the origin on
    (infinity, if no threshold does better than predicting none; also with one class only)."""
    ks = list(keys)
    best = F.max_by("threshold", F.struct(F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(0.0)), F.col("threshold")))
    return (roc.groupBy(*ks) if ks else roc.groupBy()).agg(best.alias("threshold_youden"))


def fpr_cut_threshold(roc: DataFrame, max_fpr: float = 0.05, keys=()) -> DataFrame:
    """Last ROC threshold (descending order) whose FPR <= max_fpr; the origin always qualifies."""
    ks = list(keys)
    r = roc.filter(F.col("fpr") <= max_fpr)
    return (r.groupBy(*ks) if ks else r.groupBy()).agg(F.min("threshold").alias("threshold_fpr_cut"))


def _sweep_index(x, start, step, strict: bool):
    """Largest j with start + j*step <= x (or < x when ``strict``), exact at step borders."""
    if strict:
        j0 = F.ceil((x - start) / step) - 1
        j = (j0 + F.when(start + (j0 + 1) * step < x, 1).otherwise(0)
             - F.when(start + j0 * step >= x, 1).otherwise(0))
    else:
        j0 = F.floor((x - start) / step)
        j = (j0 + F.when(start + (j0 + 1) * step <= x, 1).otherwise(0)
             - F.when(start + j0 * step > x, 1).otherwise(0))
    return j


def threshold_sweep(df: DataFrame, y: str, score: str, keys=(), step: float = 0.01,
                    max_fpr: float | None = 0.05) -> DataFrame:
    """A21 / A22 (T10): best-accuracy threshold among min, min+step, ... < max,
    predicting 1 when score >= threshold; with ``max_fpr`` only thresholds with
    FPR <= max_fpr qualify. Ties -> smallest threshold; none -> max score.
    Output: ``keys, threshold, accuracy_at_threshold``."""
    ks = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    src = src.filter(F.col(score).isNotNull())
    st = src.groupBy(*ks).agg(F.min(score).alias("mn"), F.max(score).alias("mx"))
    st = st.withColumn("J", F.ceil((F.col("mx") - F.col("mn")) / F.lit(step)))
    yy = F.col(y).cast("long")
    b = src.join(st.filter(F.col("J") > 0), ks).withColumn(
        "b", F.least(_sweep_index(F.col(score), F.col("mn"), F.lit(step), False), F.col("J") - 1))
    cnt = b.groupBy(*ks, "b").agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg"))
    # a step's counts are those of the next step that a score lies on: only such steps are rows
    t = scan(cnt, ks, ["b"], [Acc("TP", "sum", "pos", "from"), Acc("FP", "sum", "neg", "from"), Acc("_p", "sum", "pos", "before"),
                              Acc("_n", "sum", "neg", "before"), Acc("_prev", "max", "b", "before")])
    P = F.col("TP") + F.coalesce("_p", F.lit(0))
    N = F.col("FP") + F.coalesce("_n", F.lit(0))
    t = t.select(*ks, (F.coalesce("_prev", F.lit(-1)) + 1).alias("j"), ((F.col("TP") + N - F.col("FP")) / (P + N)).alias("acc"),
                 F.try_divide(F.col("FP").cast("double"), N).alias("fpr")).filter(F.col("acc") > 0)
    if max_fpr is not None:
        t = t.filter(F.col("fpr") <= max_fpr)
    best = t.groupBy(*ks).agg(F.max_by("j", F.struct(F.col("acc"), -F.col("j"))).alias("_j"), F.max("acc").alias("best_acc"))
    out = (st.join(best, ks, "left")
           .select(*ks, F.coalesce(F.col("mn") + F.col("_j") * F.lit(step), F.col("mx")).alias("threshold"),
                   F.col("best_acc")))
    return out if keys else out.drop("_all")


def calibrate(df: DataFrame, y: str, score: str, keys=(), step: float = 0.01, max_fpr: float = 0.05) -> DataFrame:
    """Youden, FPR-constrained and best-accuracy thresholds and the AUC, per key."""
    ks = list(keys) or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(1))
    roc = roc_curve(df, y, score, ks)
    yd = youden_threshold(roc, ks)
    au = auc(roc, ks)
    tf = threshold_sweep(df, y, score, ks, step, max_fpr).select(*ks, F.col("threshold").alias("threshold_fpr"))
    ta = threshold_sweep(df, y, score, ks, step, None).select(*ks, F.col("threshold").alias("threshold_acc"))
    out = yd.join(au, ks, "full").join(tf, ks, "full").join(ta, ks, "full")
    return out if keys else out.drop("_all")


def null_threshold(df: DataFrame, score: str, keys=(), step: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """From floor(min) to ceil(max) in ``step``: first t with share(score > t) <= alpha;
    none -> -1. Output ``keys, threshold``."""
    ks = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    src = src.filter(F.col(score).isNotNull())
    st = (src.groupBy(*ks).agg(F.floor(F.min(score)).cast("double").alias("f"),
                               F.ceil(F.max(score)).cast("double").alias("c"), F.count(F.lit(1)).alias("n"))
          .withColumn("J", F.ceil((F.col("c") - F.col("f")) / F.lit(step))))
    b = src.join(st.filter(F.col("J") > 0), ks).withColumn("b", F.least(_sweep_index(F.col(score), F.col("f"), F.lit(step), True),
                                                                        F.col("J") - 1))
    cnt = b.filter(F.col("b") >= 0).groupBy(*ks, "b").agg(F.count(F.lit(1)).alias("cnt"))
    # the share falls only behind a step that a score lies on; the first step is one more candidate
    after = scan(cnt, ks, ["b"], [Acc("FP", "sum", "cnt", "after")]).select(*ks, (F.col("b") + 1).alias("_at"), F.coalesce("FP", F.lit(0)).alias("FP"))
    first = st.join(cnt.groupBy(*ks).agg(F.sum("cnt").alias("FP")), ks, "left").select(*ks, F.lit(0).cast("long").alias("_at"), F.coalesce("FP", F.lit(0)).alias("FP"))
    t = after.unionByName(first).join(st, ks).filter((F.col("_at") < F.col("J")) & (F.col("FP") / F.col("n") <= alpha))
    out = st.join(t.groupBy(*ks).agg(F.min("_at").alias("_j")), ks, "left").select(
        *ks, F.coalesce(F.col("f") + F.col("_j") * F.lit(step), F.lit(-1.0)).alias("threshold"))
    return out if keys else out.drop("_all")


def apply_threshold(df: DataFrame, thresholds: DataFrame, score: str, keys, threshold_col: str = "threshold",
                    out: str = "pred", strict: bool = False) -> DataFrame:
    """Predict 1 when score >= threshold (``strict``: >)."""
    j = df.join(thresholds.select(*keys, threshold_col), list(keys))
    cmp = F.col(score) > F.col(threshold_col) if strict else F.col(score) >= F.col(threshold_col)
    return j.withColumn(out, cmp.cast("int"))


def power_tpr(pred: DataFrame, keys, pred_col: str = "pred") -> DataFrame:
    """One-class metrics on edited documents; accuracy equals TPR (FP = TN = 0)."""
    a = pred.groupBy(*keys).agg(F.avg(F.col(pred_col).cast("double")).alias("TPR"))
    return a.withColumn("accuracy", F.col("TPR"))
