"""Null distribution of responses: empirical survival functions and the per-length grid.

* ``null_sample``  (F3 F7): response or logloss column, missing values dropped.
* ``survival_1d``  (A2 T8): exact S(x) = share of observations >= x per key.
* ``fit_null_grid`` (A3 A4 A29 F10 F11): S per length sampled on G equally
  spaced points between the key's min and max response, lengths without data
  filled linearly along the length axis. All windows here run over at most G
  rows (or the number of lengths), never over raw observations.
* ``fit_fold_grids`` (A3 A4): the grids of all folds from one count of every null value.
* ``grid_pvalue`` (J2): (length, response) -> p by one equi join to the packed grid (``pack_grid``).
* ``exact_pvalue`` (J3): as-of lookup of the neighbouring null observations in sorted arrays cut by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorscan.operators.scan import Acc, scan
from authorscan.params import Params
from authorscan.session import cut_lineage, shuffle_partitions


def null_sample(df: DataFrame, keys=(), length_col: str = "length") -> DataFrame:
    """``keys, length, x`` from ``response`` (or ``logloss``), NULL/NaN dropped.

    A ``num`` column, when present, keeps only atoms after the first.
    """
    value = "response" if "response" in df.columns else "logloss"
    out = df
    if "num" in df.columns:
        out = out.filter(F.col("num") > 1)
    return (out.select(*keys, F.col(length_col).alias("length"), F.col(value).alias("x"))
            .filter(F.col("x").isNotNull() & ~F.isnan("x")))


def survival_1d(null: DataFrame, keys=("length",), log_space: bool = True) -> DataFrame:
    """A2: exact survival at every distinct value: ``keys, x, cnt, n, surv, z``.

    ``surv`` = share of observations >= x, ``z`` = -ln(surv) (log space). Counts
    per distinct value come from a hash aggregation; the suffix count is a
    skew-safe scan, so one key with most observations is still spread out.
    """
    keys = list(keys)
    vc = null.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("cnt"))
    s = scan(vc, keys, ["x"], [Acc("n", "sum", "cnt", "all"), Acc("lt", "sum", "cnt", "before")])
    s = s.withColumn("surv", (F.col("n") - F.coalesce("lt", F.lit(0))) / F.col("n"))
    z = -F.log("surv") if log_space else F.col("surv")
    return s.withColumn("z", z).select(*keys, "x", "cnt", "n", "surv", "z")


def _cell(x, xmin, dx, G: int):
    """Grid cell of a value: the first grid point at or above it."""
    at = F.least(F.lit(G - 1), F.greatest(F.lit(0), F.ceil((x - xmin) / dx)))
    return F.when(dx > 0, at).otherwise(F.lit(0)).cast("int")


def _ranges(stats: DataFrame, G: int) -> DataFrame:
    return stats.withColumn("dx", (F.col("xmax") - F.col("xmin")) / F.lit(float(max(G - 1, 1))))


def fit_null_grid(null: DataFrame, params: Params, keys=("fold",), xrange: tuple | None = None,
                  fill_lengths: bool = True) -> DataFrame:
    """Per-length log-survival grid.

    Input ``null``: ``keys, length, x``. Output: ``keys, length, g, xg, z, xg_next,
    z_next, xmin, xmax, dx, lmin, lmax`` with ``z = -ln S_length(xg)`` (``S`` itself without ``params.log_space``).
    Size is keys x lengths x G (lengths <= max_tokens - min_tokens + 1); joins to
    it are left to AQE, which broadcasts it after measuring it at run time.
    """
    G = int(params.grid_points)
    keys = list(keys)
    if xrange is None:
        stats = null.groupBy(*keys).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    else:
        stats = null.select(*keys).distinct().select(
            *keys, F.lit(float(xrange[0])).alias("xmin"), F.lit(float(xrange[1])).alias("xmax"))
    stats = _ranges(stats, G)
    vc = null.groupBy(*keys, "length", "x").agg(F.count(F.lit(1)).alias("cnt"))
    cells = (vc.join(stats, keys).withColumn("g", _cell(F.col("x"), F.col("xmin"), F.col("dx"), G))
             .groupBy(*keys, "length", "g")
             .agg(F.sum("cnt").alias("c"), F.min("x").alias("mnx"), F.max("x").alias("mxx"),
                  F.max_by("cnt", "x").alias("cm")))
    return _grid_of_cells(cells, stats, params, keys, fill_lengths)


def segment_counts(null: DataFrame, group_keys) -> DataFrame:
    """``group_keys, segment, length, x, cnt``: the null sample counted once, whatever the number of folds."""
    return null.groupBy(*group_keys, "segment", "length", "x").agg(F.count(F.lit(1)).alias("cnt"))


def fit_fold_grids(counts: DataFrame, roles: DataFrame, params: Params, group_keys=("topic",),
                   role_keys=("topic",)) -> DataFrame:
    """A3 A4 A29 for all folds (``group_keys, fold`` as keys) from one count of every null value.

    ``counts``: see :func:`segment_counts`; ``roles``: ``role_keys, segment, fold, role`` of
    :func:`~authorscan.operators.folds.fold_segments`. A fold's null sample is the union of its null segments. The folds
    of a group have at most k different grids, so a value is turned into its cell of each of them, the values of a segment
    are summed by cells, and only those sums (their number depends on the parameters) are dealt to the folds.
    """
    G = int(params.grid_points)
    gk, rk = list(group_keys), list(role_keys)
    include = roles.filter(F.col("role") == "null").select(*rk, "segment", "fold")
    ranges = counts.groupBy(*gk, "segment").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    stats = cut_lineage(_ranges(ranges.join(include, [*rk, "segment"]).groupBy(*gk, "fold")
                                .agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax")), G))
    shape = F.struct("xmin", "dx")
    grids = stats.groupBy(*gk).agg(F.sort_array(F.collect_set(shape)).alias("_grids"))  # at most k of them
    cells = (counts.join(grids, gk)
             .withColumn("_cells", F.transform("_grids", lambda r: _cell(F.col("x"), r["xmin"], r["dx"], G)))
             .groupBy(*gk, "segment", "length", "_cells")
             .agg(F.sum("cnt").alias("c"), F.min("x").alias("mnx"), F.max("x").alias("mxx"), F.max_by("cnt", "x").alias("cm")))
    which = stats.join(grids, gk).select(*gk, "fold", F.array_position("_grids", shape).cast("int").alias("_which"))
    dealt = (cells.join(include, [*rk, "segment"]).join(which, [*gk, "fold"])
             .withColumn("g", F.element_at("_cells", F.col("_which"))))
    keys = [*gk, "fold"]
    # one value may be the largest of a cell in several segments: their counts add up
    merged = (dealt.groupBy(*keys, "length", "g", "mxx").agg(F.sum("c").alias("c"), F.min("mnx").alias("mnx"), F.sum("cm").alias("cm"))
              .groupBy(*keys, "length", "g").agg(F.sum("c").alias("c"), F.min("mnx").alias("mnx"), F.max_by("cm", "mxx").alias("cm"),
                                                 F.max("mxx").alias("mxx")))
    return _grid_of_cells(cut_lineage(merged), stats, params, keys, True)


def _grid_of_cells(cells: DataFrame, stats: DataFrame, params: Params, keys: list, fill_lengths: bool) -> DataFrame:
    """Grid from per-cell sums ``keys, length, g, c, mnx, mxx, cm`` (cm: count of the cell's largest value)."""
    G = int(params.grid_points)
    nl = cells.groupBy(*keys, "length").agg(F.sum("c").alias("n"))
    lr = nl.groupBy(*keys).agg(F.max("length").alias("lmax_all"))
    valid = nl.filter(F.col("n") > 1).join(lr, keys)
    if params.parity:  # np.arange(min, max): the largest length is left out
        valid = valid.filter(F.col("length") < F.col("lmax_all"))
    valid = valid.select(*keys, "length", "n")
    scaffold = (valid.join(stats, keys)
                .select(*keys, "length", "n", "xmin", "xmax", "dx",
                        F.explode(F.sequence(F.lit(0), F.lit(G - 1))).alias("g")))
    gr = scaffold.join(cells, [*keys, "length", "g"], "left")
    w = Window.partitionBy(*keys, "length").orderBy("g")  # <= G rows per window partition
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    gr = (gr.withColumn("xlo", F.max("mxx").over(upto))
          .withColumn("cmlo", F.last("cm", ignorenulls=True).over(upto))
          .withColumn("xhi", F.min("mnx").over(after))
          .withColumn("above", F.coalesce(F.sum("c").over(after), F.lit(0))))
    xg = F.when(F.col("g") == G - 1, F.col("xmax")).otherwise(F.col("g") * F.col("dx") + F.col("xmin"))
    gr = gr.withColumn("xg", xg)
    of = (lambda share: -F.log(share)) if params.log_space else (lambda share: share)
    zlo, zhi = of((F.col("above") + F.col("cmlo")) / F.col("n")), of(F.col("above") / F.col("n"))
    first, last = (F.lit(0.0), F.log(F.col("n").cast("double"))) if params.log_space else (F.lit(1.0), F.lit(0.0))
    z = (F.when(F.col("xlo").isNull(), first)
         .when(F.col("xhi").isNull(), last)
         .otherwise((zhi - zlo) / (F.col("xhi") - F.col("xlo")) * (F.col("xg") - F.col("xlo")) + zlo))
    gr = gr.withColumn("z", z).select(*keys, "length", "g", "xg", "z", "xmin", "xmax", "dx")

    if fill_lengths:
        gr = _fill_lengths(gr, keys)
    wg = Window.partitionBy(*keys, "length").orderBy("g")
    return (gr.withColumn("xg_next", F.lead("xg").over(wg)).withColumn("z_next", F.lead("z").over(wg)))


def _fill_lengths(gr: DataFrame, keys: list) -> DataFrame:
    """A4 (linear): dense length axis, lengths without data interpolated between the
    nearest valid lengths; window partitions hold one grid column (<= #lengths rows)."""
    lr = gr.groupBy(*keys).agg(F.min("length").alias("lmin"), F.max("length").alias("lmax"),
                               F.first("xmin").alias("xmin"), F.first("xmax").alias("xmax"),
                               F.first("dx").alias("dx"))
    gcols = gr.select(*keys, "g", "xg").distinct()
    dense = (lr.select(*keys, "lmin", "lmax", "xmin", "xmax", "dx",
                       F.explode(F.sequence("lmin", "lmax")).alias("length"))
             .join(gcols, keys))
    d = dense.join(gr.select(*keys, "length", "g", F.col("z").alias("zv"),
                             F.col("length").alias("lv")), [*keys, "length", "g"], "left")
    w = Window.partitionBy(*keys, "g").orderBy("length")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fromw = w.rowsBetween(0, Window.unboundedFollowing)
    d = (d.withColumn("zl", F.last("zv", ignorenulls=True).over(upto))
         .withColumn("ll", F.last("lv", ignorenulls=True).over(upto))
         .withColumn("zh", F.first("zv", ignorenulls=True).over(fromw))
         .withColumn("lh", F.first("lv", ignorenulls=True).over(fromw)))
    z = F.when(F.col("ll") == F.col("lh"), F.col("zl")).otherwise(
        F.col("zl") + (F.col("length") - F.col("ll")) / (F.col("lh") - F.col("ll")) * (F.col("zh") - F.col("zl")))
    return d.withColumn("z", z).select(*keys, "length", "g", "xg", "z", "xmin", "xmax", "dx", "lmin", "lmax")


def pack_grid(grid: DataFrame, keys=("fold",), lengths: tuple[int, int] | None = None) -> DataFrame:
    """One row per (keys, length) with the length's grid points as one dense array.

    Every key gets a row for all ``lengths`` (first, last), those outside its fitted range with the nearest fitted
    length's points; a row is at most G points, and a lookup needs one equi join on (keys, length).
    """
    keys = list(keys)
    points = F.sort_array(F.collect_list(F.struct("g", "xg", "z")))  # <= G of them
    rows = grid.groupBy(*keys, "length").agg(points.alias("points"), *[F.first(c).alias(c) for c in ("xmin", "xmax", "dx", "lmin", "lmax")])
    if lengths:
        lo, hi = (F.lit(int(n)) for n in lengths)
        none = F.array().cast("array<int>")
        n = F.col("length").cast("int")
        below = F.when((n == F.col("lmin")) & (lo < n), F.sequence(lo, n - 1)).otherwise(none)
        above = F.when((n == F.col("lmax")) & (hi > n), F.sequence(n + 1, hi)).otherwise(none)
        rows = rows.withColumn("length", F.explode(F.concat(below, F.array(n), above)))
    return rows.drop("lmin", "lmax")


def grid_pvalue(df: DataFrame, grid: DataFrame, keys=("fold",), length_col: str = "eff_length",
                x_col: str = "response", out: str = "pvalue", lengths: tuple[int, int] | None = None,
                log_space: bool = True) -> DataFrame:
    """p = exp(-z) (z itself without ``log_space``) at (length, x), linear between the two grid points around x.

    Lengths outside the fitted range take the nearest fitted length, responses
    outside [xmin, xmax] the end value; p is clipped to (0, 1]. Rows with a NULL
    length or response get a NULL p. ``lengths`` bounds the lengths of ``df`` (they are
    measured if it is None). One join, on (keys, length), to the packed grid; the cell is an index into its row.
    """
    keys = list(keys)
    if lengths is None:
        seen = df.agg(F.min(length_col), F.max(length_col)).first()
        lengths = None if seen[0] is None else (seen[0], seen[1])
    packed = pack_grid(grid, keys, lengths).select(*keys, F.col("length").alias("_l"), "points", "xmin", "xmax", "dx")
    d = df.withColumn("_l", F.col(length_col).cast("int")).join(packed, [*keys, "_l"], "left")
    x = F.least(F.greatest(F.col(x_col), F.col("xmin")), F.col("xmax"))
    last = F.greatest(F.size("points") - 2, F.lit(0))
    cell = F.when(F.col("dx") > 0, F.least(F.greatest(F.floor((x - F.col("xmin")) / F.col("dx")), F.lit(0)), last)).otherwise(F.lit(0))
    d = d.withColumn("_x", x).withColumn("_a", F.get("points", cell.cast("int"))).withColumn("_b", F.get("points", cell.cast("int") + 1))
    a, b = F.col("_a"), F.col("_b")
    zi = F.when(b.isNull() | (b["xg"] == a["xg"]), a["z"]).otherwise(
        (b["z"] - a["z"]) / (b["xg"] - a["xg"]) * (F.col("_x") - a["xg"]) + a["z"])
    # least() skips NULLs: a missing grid row must stay NULL, not become p = 1
    p = F.when(F.col(length_col).isNull() | F.col(x_col).isNull() | zi.isNull(),
               F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.exp(-zi) if log_space else zi))
    return d.withColumn(out, p).drop("_l", "_x", "_a", "_b", "points", "xmin", "xmax", "dx")


RANGE_VALUES = 50_000  # null values of one range, about
BUCKET_ROWS = 200_000  # rows that one task looks up at once, about


def _below(bounds, x, n: int):
    """Number of the sorted ``bounds`` (at most n) below ``x``: a binary search in the row."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(bounds, at + k - 1) < x, at + k).otherwise(at))


def exact_pvalue(df: DataFrame, null: DataFrame, keys=("fold",), length_col: str = "eff_length",
                 x_col: str = "response", id_cols=("doc_id", "atom_no"), out: str = "pvalue",
                 range_values: int = RANGE_VALUES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """P from the exact 1-D survival of the same length (no grid).

    The largest null value <= x, the smallest > x and the suffix count give S at both ends; z is linear
    in x between them (0 below the smallest null value, ln n above the largest). A length without
    null rows has no p-value (NULL). ``null`` has one row per observation, or per value with its count ``cnt``.

    As-of lookup without stacking: the values of a (keys, length) are cut into ranges at their quantiles, and values and
    queries of one range meet in one task, where a sorted array is searched. What lies in the other ranges enters by the
    ranges' totals (one row each). Several ranges share a task by hash, so a hot length is spread and small ones cost no task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, kl = list(keys), [*keys, "_l"]
    count = F.sum("cnt") if "cnt" in null.columns else F.count(F.lit(1))
    vc = cut_lineage(null.filter(F.col("x").isNotNull()).groupBy(*keys, F.col("length").cast("int").alias("_l"), "x").agg(count.cast("long").alias("cnt")))
    sizes = vc.groupBy(*kl).agg(F.count(F.lit(1)).alias("m"), F.sum("cnt").alias("_n"))
    most = sizes.agg(F.max("m")).first()[0] or 0
    parts = max(1, -(-most // range_values))
    cuts = [i / parts for i in range(1, parts)]
    bounds = (F.array_distinct(F.percentile_approx("x", cuts, max(10_000, 4 * parts))) if cuts else F.array().cast("array<double>"))
    spans = cut_lineage(vc.groupBy(*kl).agg(bounds.alias("_bounds"), F.sum("cnt").alias("_n")).withColumn("_kid", F.monotonically_increasing_id()))
    n = parts - 1
    cell = (_below(F.col("_bounds"), F.col("x"), n) if n else F.lit(0)).cast("int")
    # the planner reads real sizes: spans has one row per key and length
    values = vc.join(spans, kl).select("_kid", cell.alias("_cell"), "x", "cnt")
    totals = values.groupBy("_kid", "_cell").agg(F.sum("cnt").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max_by("cnt", "x").alias("hc"))
    all_cells = spans.select("_kid", F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_cell"))
    w = Window.partitionBy("_kid").orderBy("_cell")  # the ranges of one key and length
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carry = cut_lineage(all_cells.join(totals, ["_kid", "_cell"], "left").select(
        "_kid", "_cell", F.last("hi", ignorenulls=True).over(before).alias("_xlo"), F.last("hc", ignorenulls=True).over(before).alias("_clo"),
        F.first("lo", ignorenulls=True).over(after).alias("_xhi"), F.coalesce(F.sum("c").over(after), F.lit(0)).alias("_above")))

    asked = df.withColumn("_l", F.col(length_col).cast("int"))
    if x_col != "x":
        asked = asked.withColumn("x", F.col(x_col).cast("double"))
    asked = asked.join(spans, kl, "left")
    asked = asked.withColumn("_cell", F.when(F.col("x").isNotNull(), cell)).join(carry, ["_kid", "_cell"], "left")
    columns = df.columns
    helpers = ["_kid", "_cell", "_n", "_xlo", "_clo", "_xhi", "_above"]
    have = F.col("_kid").isNotNull() & F.col("_cell").isNotNull()
    extra = ["x"] if x_col != "x" else []
    queries = asked.filter(have).select(*columns, *extra, *helpers)
    without = asked.filter(~have).select(*columns, F.lit(None).cast("double").alias(out))
    tasks = max(1, -(-vc.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("_kid", "_cell"), F.lit(max(tasks, shuffle_partitions(df.sparkSession))))
    schema = without.schema
    arrow = to_arrow_schema(schema)

    def look_up(values: pa.Table, asked: pa.Table) -> pa.Table:
        q = {c: asked.column(c).to_numpy(zero_copy_only=False) for c in ("x", *helpers)}
        v = {c: values.column(f"v{c}").to_numpy(zero_copy_only=False) for c in ("_kid", "_cell", "x", "cnt")}
        p = _exact(q, v) if asked.num_rows else []
        return pa.table([*(asked.column(c) for c in columns), pa.array(p, pa.float64())], schema=arrow)

    named = values.select(bucket.alias("v_b"), *[F.col(c).alias(f"v{c}") for c in ("_kid", "_cell", "x", "cnt")])  # names of their own
    met = (named.groupBy("v_b")
           .cogroup(queries.withColumn("_b", bucket).groupBy("_b")).applyInArrow(look_up, schema))
    return met.unionByName(without)


def _exact(q: dict, v: dict):
    """p-values of the queries ``q`` among the null values ``v`` of their ranges and what ``q`` knows of the other ranges."""
    import numpy as np

    order = np.lexsort((v["x"], v["_cell"], v["_kid"]))
    v = {k: a[order] for k, a in v.items()}
    m, nq = v["x"].size, q["x"].size
    stacked = np.lexsort((np.r_[np.zeros(m), np.ones(nq)], np.r_[v["x"], q["x"]], np.r_[v["_cell"], q["_cell"]], np.r_[v["_kid"], q["_kid"]]))
    at = np.empty(nq, np.int64)  # values of earlier ranges, and of this one up to x
    asks = stacked >= m
    at[stacked[asks] - m] = np.cumsum(~asks)[asks]
    start = np.r_[True, (v["_kid"][1:] != v["_kid"][:-1]) | (v["_cell"][1:] != v["_cell"][:-1])] if m else np.zeros(0, bool)
    edges = np.r_[np.flatnonzero(start), m]
    run = np.searchsorted(edges, at - 1, "right") - 1  # the run of the value just below
    own = lambda i: (i >= 0) & (i < m) & (v["_kid"][i.clip(0, max(m - 1, 0))] == q["_kid"]) & (v["_cell"][i.clip(0, max(m - 1, 0))] == q["_cell"]) if m else np.zeros(nq, bool)
    below, beyond = own(at - 1), own(at)
    lo, hi = (at - 1).clip(0, max(m - 1, 0)), at.clip(0, max(m - 1, 0))
    number = lambda a: np.asarray(a, np.float64)  # noqa: E731  NULL is NaN
    pick = lambda has, column, i, other: np.where(has, number(v[column])[i], number(other)) if m else number(other)
    xlo, clo = pick(below, "x", lo, q["_xlo"]), pick(below, "cnt", lo, q["_clo"])
    xhi = pick(beyond, "x", hi, q["_xhi"])
    sums = np.r_[0, np.cumsum(v["cnt"])]
    last = np.where(below, edges[(run + 1).clip(0, edges.size - 1)], at)
    last = np.where(~below & beyond, edges[np.searchsorted(edges, at, "right").clip(0, edges.size - 1)], last)
    above = number(q["_above"]) + (sums[last] - sums[at])
    n, x = number(q["_n"]), number(q["x"])
    with np.errstate(all="ignore"):
        zlo, zhi = -np.log((above + clo) / n), -np.log(above / n)
        z = np.where(np.isnan(xlo), 0.0, np.where(np.isnan(xhi), np.log(n), (zhi - zlo) / (xhi - xlo) * (x - xlo) + zlo))
        return np.minimum(1.0, np.exp(-z))
