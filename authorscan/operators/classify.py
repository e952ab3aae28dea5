"""Embedding baseline: logistic regression for every (topic, edit ratio, fold) at once.

Rows of a key (topic, edit ratio, ...) are split into edited / not-edited groups, each cut into contiguous
blocks (row order = id); for every fold the fold's blocks are test rows, the rest is shuffled by md5(id, seed) and
split 80/20 into training and validation rows. One scan finds a row's part in all folds.

All models are fitted together: rows are packed into blocks of one key, stored once, and each Newton step is one Spark
job that sums gradients and Hessians per (key, fold) over the blocks and updates the models. The number of jobs is that
of the steps, whatever the number of topics, ratios and folds. The validation ROC gives the threshold with
FPR <= 5 %, applied to the test rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from authorscan.operators.evaluate import binary_metrics, fpr_cut_threshold, roc_curve
from authorscan.operators.folds import indexed
from authorscan.operators.scan import Acc, scan
from authorscan.params import Params
from authorscan.session import cut_lineage

SEED = 555  # fixed value: shuffle seed of the published run
TRAIN, VALIDATION, TEST = 0, 1, 2
BLOCK_ROWS = 4096
MAX_STEPS = 50
TOLERANCE = 1e-9
ONE_CLASS = 700.0  # intercept of a model whose training rows are of one class: its probability is that class


def embedding_features(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    """``features`` (array of doubles) from an array column, or from the ``dim_*`` columns in their order."""
    if array_col in df.columns:
        return df.withColumn("features", F.col(array_col).cast("array<double>"))
    return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in df.columns if "dim_" in c]))


def read_embedding_pairs(spark: SparkSession, paths) -> DataFrame:
    """Embedding files ``{topic}/edit_ratio_{r}/{topic}_embedded_(edited|not_edited).csv``, all in one read.

    Adds ``topic`` and ``edit_ratio`` from the path, the label ``edited`` from the file's name, ``features``,
    and ``row``, the row's place in its file; the two files of a topic and ratio are aligned by it.
    """
    raw = (spark.read.option("header", True).option("inferSchema", True).csv(paths)
           .select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                   F.monotonically_increasing_id().alias("_seen")))
    part = r"([^/]+)/edit_ratio_([^/]+)/[^/]*_embedded_(not_)?edited[^/]*$"
    keyed = embedding_features(raw.withColumn("topic", F.regexp_extract("_path", part, 1))
                               .withColumn("edit_ratio", F.regexp_extract("_path", part, 2).cast("double"))
                               .withColumn("edited", (F.regexp_extract("_path", part, 3) == "").cast("int")))
    out = indexed(keyed.select("topic", "edit_ratio", "edited", "features", "_start", "_seen"), ["topic", "edit_ratio", "edited"], ["_start", "_seen"])
    return out.withColumnRenamed("row_index", "row").drop("_start", "_seen", "n_rows")


def fold_parts(rows: DataFrame, params: Params, keys, id_col: str) -> DataFrame:
    """W4 W7 for all folds: ``rows`` with ``parts``, one entry a fold (0 training, 1 validation, 2 test).

    ``keys`` hold no NULL; (``keys``, ``edited``, ``id_col``) names a row.
    """
    k, ks = int(params.k_folds), list(keys)
    d = indexed(rows, [*ks, "edited"], [id_col])
    d = d.withColumn("block", F.floor(F.col("row_index") * k / F.col("n_rows")).cast("int")).drop("row_index", "n_rows")
    d = d.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(SEED)))))
    accs = [Acc("_r", "sum", F.lit(1), "before"), Acc("_a", "sum", F.lit(1), "from")]
    for f in range(k):
        here = (F.col("block") == f).cast("int")
        accs += [Acc(f"_b{f}", "sum", here, "before"), Acc(f"_f{f}", "sum", here, "from")]
    s = scan(d, ks, ["_h", id_col, "edited"], accs)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))

    def part(f: int) -> Column:
        others = z("_r") + z("_a") - z(f"_b{f}") - z(f"_f{f}")
        cut = F.floor(others * F.lit(float(params.train_split)))
        return F.when(F.col("block") == f, TEST).when(z("_r") - z(f"_b{f}") < cut, TRAIN).otherwise(VALIDATION)

    return s.select(*[c for c in d.columns if c != "_h"], F.array(*[part(f) for f in range(k)]).alias("parts"))


# -------------------------------------------------------------------- fitting


def _pack(rows: DataFrame, keys: list, id_col: str) -> DataFrame:
    """Rows of one key and partition as blocks ``keys, n, ids, y, parts, x`` (float64 rows with a last component one)."""
    schema = StructType([*[rows.schema[c] for c in keys], *StructType.fromDDL("n int, ids binary, y binary, parts binary, x binary").fields])
    out = to_arrow_schema(schema)

    def pack(it):
        held, size = [], 0

        def blocks(t: pa.Table):
            key = list(zip(*(t.column(c).to_pylist() for c in keys), strict=True))
            starts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for i, j in zip(starts, starts[1:], strict=False):
                s = t.slice(i, j - i).combine_chunks()
                x = np.array(s.column("features").to_pylist(), np.float64).reshape(j - i, -1)
                x = np.hstack([x, np.ones((j - i, 1))])
                cols = [s.column(id_col).to_numpy().astype(np.int64), s.column("edited").to_numpy().astype(np.uint8),
                        np.array(s.column("parts").to_pylist(), np.uint8), x]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(key[i], out, strict=False)),
                                                  pa.array([j - i], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], schema=out)

        for rb in it:
            held.append(rb)
            size += rb.num_rows
            if size >= BLOCK_ROWS:
                yield from blocks(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from blocks(pa.Table.from_batches(held))

    narrow = rows.select(*keys, F.col(id_col).cast("long").alias(id_col), "edited", "parts", "features")
    return cut_lineage(narrow.sortWithinPartitions(*keys).mapInArrow(pack, schema))


def _blocks(rb: pa.RecordBatch, keys: list, k: int):
    """(key values, ids, labels, parts, design matrix, weights by fold) of each block of a batch."""
    for r in rb.to_pylist():
        n = r["n"]
        yield (tuple(r[c] for c in keys), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["y"], np.uint8).astype(np.float64),
               np.frombuffer(r["parts"], np.uint8).reshape(n, k), np.frombuffer(r["x"]).reshape(n, -1), np.array(r["ws"], np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _step(w, w_before, loss_before, g, h, loss, n, positives):
    """One Newton step of sum(log loss) + |weights|^2 / 2 with a free intercept; a step that raised the loss is halved."""
    if n == 0 or positives in (0, n):  # one class: no finite optimum
        flat = np.zeros_like(w)
        flat[-1] = (ONE_CLASS if positives else -ONE_CLASS) if n else 0.0
        return flat, flat, loss, 0.0
    free = np.ones_like(w)
    free[-1] = 0.0
    loss += 0.5 * float(((w * free) ** 2).sum())
    if loss > loss_before + 1e-9 * abs(loss_before):
        return (w + w_before) / 2, w_before, loss_before, float(np.abs(w - w_before).max())
    d = np.linalg.solve(h + np.diag(free) + 1e-12 * np.eye(w.size), g + free * w)
    return w - d, w, loss, float(np.abs(d).max())


def fit_models(blocks: DataFrame, keys, k: int, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """M7 for all (``keys``, fold): ``keys, fold, w`` (the intercept last). Each step is one job over the stored blocks."""
    ks = list(keys)
    key_fields = [blocks.schema[c] for c in ks]
    width = F.expr("array_repeat(0D, int(length(x) / n / 8))")
    state = StructType([*key_fields, *StructType.fromDDL(
        "fold int, w array<double>, w_before array<double>, loss_before double, step double").fields])
    sums = StructType([*key_fields, *StructType.fromDDL("fold int, g binary, h binary, loss double, n long, positives long").fields])
    arrow_sums, arrow_state = to_arrow_schema(sums), to_arrow_schema(state)
    models = cut_lineage(blocks.groupBy(*ks).agg(F.first(width).alias("w")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *ks, "fold", "w", F.col("w").alias("w_before"), F.lit(float("inf")).alias("loss_before"), F.lit(float("inf")).alias("step")))

    def partial(it):
        held: dict = {}

        def rows():
            for key, (g, h, loss, n, pos) in held.items():
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([v] * k, f.type) for v, f in zip(key, arrow_sums, strict=False)), pa.array(range(k), pa.int32()),
                    pa.array([x.tobytes() for x in g], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary()),
                    pa.array(loss), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))], schema=arrow_sums)
            held.clear()

        for rb in it:
            for key, _, y, parts, x, w in _blocks(rb, ks, k):
                z = x @ w.T
                p, train = _sigmoid(z), parts == TRAIN
                g = ((p - y[:, None]) * train).T @ x
                v = p * (1 - p) * train
                h = np.stack([(x * v[:, f:f + 1]).T @ x for f in range(k)])
                loss = ((np.logaddexp(0, z) - y[:, None] * z) * train).sum(0)
                new = [g, h, loss, train.sum(0), (train & (y[:, None] == 1)).sum(0)]
                held[key] = [a + b for a, b in zip(held[key], new, strict=True)] if key in held else new
                if len(held) > 64:
                    yield from rows()
        yield from rows()

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow_state.empty_table()
        m = left.to_pylist()[0]
        w, before = np.array(m["w"]), np.array(m["w_before"])
        g, h = (sum((np.frombuffer(b) for b in right.column(c).to_pylist()), np.zeros(n)) for c, n in (("g", w.size), ("h", w.size ** 2)))
        loss, n, pos = (sum(right.column(c).to_pylist()) for c in ("loss", "n", "positives"))
        w, before, loss, step = _step(w, before, m["loss_before"], g, h.reshape(w.size, w.size), loss, n, pos)
        m |= {"w": w.tolist(), "w_before": before.tolist(), "loss_before": loss, "step": step}
        return pa.Table.from_pylist([m], schema=arrow_state)

    for _ in range(max_steps):
        found = _with_weights(blocks, models, ks).mapInArrow(partial, sums)
        models = cut_lineage(models.groupBy(*ks, "fold").cogroup(found.groupBy(*ks, "fold")).applyInArrow(update, state))
        if (models.agg(F.max("step")).first()[0] or 0.0) < tolerance:
            break
    return models.select(*ks, "fold", "w")


def _with_weights(blocks: DataFrame, models: DataFrame, keys: list) -> DataFrame:
    by_key = models.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fold", "w"))).alias("m"))  # one entry a fold
    return blocks.join(by_key.select(*keys, F.transform("m", lambda x: x["w"]).alias("ws")), keys)


def predict(blocks: DataFrame, models: DataFrame, keys, k: int, id_col: str) -> DataFrame:
    """``keys, fold, id, edited, part, proba, pred`` of every validation and test row."""
    ks = list(keys)
    schema = StructType([*[blocks.schema[c] for c in ks], *StructType.fromDDL(
        f"fold int, {id_col} long, edited int, part string, proba double, pred int").fields])
    out = to_arrow_schema(schema)

    def run(it):
        for rb in it:
            for key, ids, y, parts, x, w in _blocks(rb, ks, k):
                row, fold = np.nonzero(parts != TRAIN)
                p = _sigmoid((x @ w.T)[row, fold])
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([v] * row.size, f.type) for v, f in zip(key, out, strict=False)), pa.array(fold.astype(np.int32)), pa.array(ids[row]),
                    pa.array(y[row].astype(np.int32)), pa.array(np.where(parts[row, fold] == TEST, "test", "validation")),
                    pa.array(p), pa.array((p > 0.5).astype(np.int32))], schema=out)

    return _with_weights(blocks, models, ks).mapInArrow(run, schema)


def lor_cv(rows: DataFrame, params: Params, keys=("topic", "edit_ratio"), id_col: str = "vec_id") -> dict:
    """``rows`` (``keys``, id, ``edited``, ``features``) -> parts, models, predictions, per_fold, summary.

    Rows without features or with a NULL key take no part. A fold without test rows has no result; a fold counts if its accuracy is above 0.
    """
    ks, k = list(keys), int(params.k_folds)
    fk = [*ks, "fold"]
    parts = fold_parts(rows.select(*ks, id_col, "edited", "features").dropna(), params, ks, id_col)
    parts = cut_lineage(parts)
    blocks = _pack(parts, ks, id_col)
    models = fit_models(blocks, ks, k)
    found = cut_lineage(predict(blocks, models, ks, k, id_col))
    val, test = (found.filter(F.col("part") == p) for p in ("validation", "test"))
    th = fpr_cut_threshold(roc_curve(val, "edited", "proba", fk), params.max_fpr, fk)
    adj = test.join(th, fk, "left").withColumn("pred_adj", (F.col("proba") >= F.col("threshold_fpr_cut")).cast("int"))
    m_adj = binary_metrics(adj, "edited", "pred_adj", fk).select(*fk, F.col("accuracy").alias("accuracy_at_FPR_005"))
    m = binary_metrics(test, "edited", "pred", fk, fpr_zero_if_no_negatives=True).select(*fk, "accuracy", "FPR")
    per_fold = m.join(m_adj, fk).filter(F.col("accuracy") > 0)
    summary = per_fold.groupBy(*ks).agg(
        F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("FPR").alias("FPR"), F.stddev_samp("FPR").alias("FPR_std"),
        F.avg("accuracy_at_FPR_005").alias("accuracy_005"),
        F.stddev_samp("accuracy_at_FPR_005").alias("accuracy_005_std")).withColumns(
        {"model": F.lit("logistic_regression"), "statistics": F.lit("embedding")})
    return {"parts": parts, "models": models, "predictions": found, "per_fold": per_fold, "summary": summary}
