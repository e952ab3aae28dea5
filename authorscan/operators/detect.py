"""Per-sentence p-values and per-document tests.

* ``apply_length_policy`` (F8 F9 F6 O5): effective length and comment per atom.
* ``sentence_pvalues`` (M6 J2): p-value of every atom from the null grid.
* ``document_tests`` (F4 A5 A6 A7 A8 A9 A10 W11 M4 M5 Q1): HC, HC threshold,
  Fisher and its p-value, minP, Bonferroni, number of valid atoms. Ranks come
  from a skew-safe scan over distinct p-values (ties pre-aggregated), sums and
  minima from the same rows: no document is ever gathered into one row.
* ``sentence_mask`` (W12 O6), ``precision_recall`` (A12).
* ``hc_null_table`` (A30 S15) and ``hc_pvalue`` (J4).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorscan.functions.stats import chi2_even_sf, hc_imax, hc_term
from authorscan.functions.text import truncate_tokens
from authorscan.operators.corpus import TAG_EDIT
from authorscan.operators.scan import Acc, scan
from authorscan.operators.survival import fit_null_grid, grid_pvalue
from authorscan.params import Params

# Comments of the length policy.
C_OK = "OK"
C_NO_RESPONSE = "ignored (no response)"
C_SHORT = "ignored (below minimal length)"
C_LONG_IGNORED = "ignored (above maximum limit)"
C_MAX_AVAILABLE = "exceeding length limit; resorting to max-available length"
C_FIRST = "ignored (first sentence)"


def c_truncated(max_len: int) -> str:
    return f"truncated to {max_len} tokens"


def truncate_for_scoring(atoms: DataFrame, params: Params, text_col: str = "text") -> DataFrame:
    """With the ``truncate`` policy the scored text is cut to ``max_len`` words."""
    if params.length_policy == "truncate":
        return atoms.withColumn("scored_text", truncate_tokens(text_col, params.max_len))
    return atoms.withColumn("scored_text", F.col(text_col))


def apply_length_policy(df: DataFrame, params: Params, length_col: str = "length",
                        response_col: str = "response", doc_keys=None, order_col: str = "atom_no") -> DataFrame:
    """F8 F9 (+F6 when ``params.ignore_first_sentence``): ``eff_length`` and ``comment``.

    ``eff_length`` is NULL where no p-value is computed.
    """
    L, r = F.col(length_col), F.col(response_col)
    mx, mn = params.max_len, params.min_len
    pol = params.length_policy
    if pol == "truncate":
        long_len, long_c = F.lit(mx), F.lit(c_truncated(mx))
    elif pol == "ignore":
        long_len, long_c = F.lit(None).cast("int"), F.lit(C_LONG_IGNORED)
    elif pol == "max_available":
        long_len, long_c = F.lit(mx), F.lit(C_MAX_AVAILABLE)
    else:
        raise ValueError(f"unknown length policy {pol!r}")
    nan = r.isNull() | F.isnan(r)
    eff = (F.when(nan, F.lit(None)).when(L < mn, F.lit(None)).when(L > mx, long_len).otherwise(L))
    com = (F.when(nan, F.lit(C_NO_RESPONSE)).when(L < mn, F.lit(C_SHORT)).when(L > mx, long_c)
           .otherwise(F.lit(C_OK)))
    out = df.withColumn("eff_length", eff.cast("int")).withColumn("comment", com)
    if params.ignore_first_sentence:
        keys = list(doc_keys)
        first = out.groupBy(*keys).agg(F.min(order_col).alias("_first"))
        out = (out.join(first, keys, "left")
               .withColumn("eff_length", F.when(F.col(order_col) == F.col("_first"), F.lit(None))
                           .otherwise(F.col("eff_length")))
               .withColumn("comment", F.when(F.col(order_col) == F.col("_first"), F.lit(C_FIRST))
                           .otherwise(F.col("comment")))
               .drop("_first"))
    return out


def sentence_pvalues(scored: DataFrame, grid: DataFrame, params: Params, keys=("fold",),
                     doc_keys=None) -> DataFrame:
    """M6: policy + grid lookup. Adds ``eff_length, comment, pvalue``. The comments follow from the rows and aren't dealt for the
    lookup (where a first sentence is ignored, from its document too)."""
    d = apply_length_policy(scored, params, doc_keys=doc_keys)
    rows = d if params.ignore_first_sentence else d.drop("comment")
    out = grid_pvalue(rows, grid, keys, "eff_length", "response", "pvalue", (params.min_len, params.max_len), params.log_space)
    return out if params.ignore_first_sentence else apply_length_policy(out, params).select(*d.columns, "pvalue")


def document_tests(pv: DataFrame, doc_keys, params: Params, p_col: str = "pvalue",
                   documents: DataFrame | None = None, weight_col: str | None = None) -> DataFrame:
    """Per-document HC (+threshold), Fisher (+p-value), minP, Bonferroni, n valid.

    HC: over the smallest imax = max(1, floor(gamma n + 0.5)) ordered p-values,
    max of the standardised excess; the threshold is p at the first maximiser.
    Tied p-values form one group whose best index is min(last index, imax)
    (the excess grows with i at fixed p). ``documents`` (the full list of
    document keys; ``pv`` itself for all that have a row) brings back documents without any valid atom with NULL tests. A row stands for
    ``weight_col`` p-values if that is given. ``pv`` is read once: all tests follow from the counts of distinct p-values. A document
    with a NULL key has no tests.
    """
    keys = list(doc_keys)
    weight = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = pv.select(*keys, F.when(known, F.col(p_col)).alias("p"), weight.alias("_w"))
    if documents is not pv:
        rows = rows.filter(F.col("p").isNotNull())
    groups = rows.groupBy(*keys, "p").agg(F.sum(F.when(F.col("p").isNotNull(), F.col("_w")).otherwise(0)).alias("m"))
    groups = scan(groups, keys, ["p"], [Acc("c", "sum", "m", "upto"), Acc("_all", "sum", "m", "all")])
    g = (groups.withColumn("_n", F.when(F.col("_all") > 0, F.col("_all")))
         .withColumn("_imax", hc_imax("_n", params.gamma))
         .withColumn("_i", F.least("c", "_imax"))
         .withColumn("_hc", F.when(F.col("p").isNotNull() & (F.col("c") - F.col("m") + 1 <= F.col("_imax")),
                                   hc_term("_i", "_n", "p", params.hc_variant))))
    res = g.groupBy(*keys).agg(F.sum("m").alias("n_valid"),
                               F.sum(F.col("m") * -2 * F.log("p")).alias("fisher"),
                               F.min("p").alias("_pmin"),
                               F.max("_hc").alias("HC"),
                               F.max_by("p", F.when(F.col("_hc").isNotNull(), F.struct(F.col("_hc"), -F.col("p")))).alias("hc_threshold"))
    res = (res.withColumn("fisher_pvalue", F.when(F.col("n_valid") > 0, chi2_even_sf(F.col("fisher"), F.col("n_valid"))))
           .withColumn("minP", -F.log("_pmin"))
           .withColumn("bonf", F.when(F.col("n_valid") > 0, F.least(F.lit(1.0), F.col("n_valid") * F.col("_pmin"))))
           .drop("_pmin"))
    if documents is not None and documents is not pv:
        res = documents.select(*keys).distinct().join(res, keys, "left").withColumn(
            "n_valid", F.coalesce("n_valid", F.lit(0)))
    return res


def sentence_mask(pv: DataFrame, tests: DataFrame, doc_keys, p_col: str = "pvalue") -> DataFrame:
    """``mask`` = p <= HC threshold of the document (NULL without a p-value)."""
    keys = list(doc_keys)
    t = tests.select(*keys, "hc_threshold")
    return pv.join(t, keys, "left").withColumn(
        "mask", F.when(F.col(p_col).isNotNull() & F.col("hc_threshold").isNotNull(),
                       F.col(p_col) <= F.col("hc_threshold"))).drop("hc_threshold")


def top_sentences(pv: DataFrame, doc_keys, k: int, p_col: str = "pvalue", tie_cols=("atom_no",)) -> DataFrame:
    """The k most anomalous atoms (smallest p) of every document (a top-k report)."""
    keys = list(doc_keys)
    v = pv.filter(F.col(p_col).isNotNull())
    r = scan(v, keys, [F.col(p_col), *[F.col(c) for c in tie_cols]], [Acc("rank", "sum", F.lit(1), "upto")])
    return r.filter(F.col("rank") <= k)


def precision_recall(masked: DataFrame, doc_keys) -> DataFrame:
    """Precision / recall of the mask against the ``<edit>`` tags, NULL on 0/0."""
    keys = list(doc_keys)
    is_edit = (F.coalesce(F.col("tag"), F.lit("no edits")) == TAG_EDIT).cast("int")
    m = F.coalesce(F.col("mask"), F.lit(False)).cast("int")
    agg = masked.groupBy(*keys).agg(F.sum(m * is_edit).alias("_tp"), F.sum(m).alias("_m"),
                                    F.sum(is_edit).alias("_e"),
                                    F.avg(is_edit.cast("double")).alias("edit_rate"))
    return agg.select(*keys, "edit_rate",
                      F.try_divide(F.col("_tp").cast("double"), F.col("_m")).alias("precision"),
                      F.try_divide(F.col("_tp").cast("double"), F.col("_e")).alias("recall"))


def nearest_bucket(n, sizes) -> object:
    """Nearest value of the ``sizes`` list (ties -> smaller)."""
    sizes = sorted(sizes)
    expr = F.lit(sizes[-1])
    for a, b in reversed(list(zip(sizes, sizes[1:]))):
        expr = F.when(F.col(n) <= (a + b) / 2.0, F.lit(a)).otherwise(expr) if isinstance(n, str) else \
            F.when(n <= (a + b) / 2.0, F.lit(a)).otherwise(expr)
    return expr


# HC grid of the null table, 57 points from -1 to 8.
HC_GRID = (-1.0, 8.0, 57)


def hc_null_table(doc_scores: DataFrame, params: Params, keys=(), sizes=None) -> DataFrame:
    """Survival of HC under the null from observed unedited documents.

    Rows: ``keys, length (= n bucket), g, xg, z, ...`` with ``gamma`` and
    ``variant`` as columns so a stored table can be filtered by parameters.
    """
    sizes = sizes or params.hc_null_sizes
    keys = list(keys) or ["_k"]
    src = doc_scores if "_k" not in keys else doc_scores.withColumn("_k", F.lit(1))
    null = (src.filter(F.col("HC").isNotNull())
            .select(*keys, nearest_bucket("n_valid", sizes).alias("length"), F.col("HC").alias("x")))
    p = params.with_(grid_points=HC_GRID[2], parity=False, log_space=True)
    grid = fit_null_grid(null, p, keys=keys, xrange=HC_GRID[:2], fill_lengths=False)
    bounds = grid.groupBy(*keys).agg(F.min("length").alias("lmin"), F.max("length").alias("lmax"))
    return (grid.join(bounds, keys).withColumn("gamma", F.lit(float(params.gamma)))
            .withColumn("variant", F.lit(params.hc_variant)))


def hc_pvalue(doc_scores: DataFrame, hc_null: DataFrame, keys=()) -> DataFrame:
    """HC p-value from (n valid, HC) via the nearest bucket (ties -> smaller) that the
    HC null table has for the document's key; NULL if it has none for it."""
    tbl = hc_null.drop("gamma", "variant")
    d = doc_scores
    if not keys:
        d = d.withColumn("_k", F.lit(1))
        keys = ("_k",)
    present = tbl.groupBy(*keys).agg(F.collect_set("length").alias("_present"))  # at most one value per bucket size
    near = F.array_min(F.transform("_present", lambda s: F.struct(F.abs(s - F.col("n_valid")).alias("d"), s.alias("s"))))
    d = d.join(present, list(keys), "left").withColumn("_bucket", near["s"])
    out = grid_pvalue(d, tbl, keys, "_bucket", "HC", "HC_pvalue", ())  # a bucket that is present needs no neighbour
    return out.drop("_bucket", "_present", "_k")
