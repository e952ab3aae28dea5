"""One scan and one scoring for all folds, ratios and sizes; packed grid, range lookups and sparse sweeps
against their plain forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from authorscan.operators.corpus import Setting, article_atoms, atoms_of, candidate_atoms
from authorscan.operators.evaluate import null_threshold, threshold_sweep
from authorscan.operators.folds import fold_roles, fold_segments
from authorscan.operators.survival import exact_pvalue, fit_fold_grids, fit_null_grid, grid_pvalue, segment_counts
from authorscan.params import Params

RND = random.Random(7)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def articles(spark, sizes):
    return spark.createDataFrame([(t, i) for t, n in sizes.items() for i in range(n)], "topic string, doc_id long")


@pytest.mark.parametrize("params", [Params(), Params(k_folds=3, window_size=2), Params(k_folds=7, train_split=0.55), Params(parity=True),
                                    Params(k_folds=5, window_size=3, parity=True)])
def test_segments_give_the_fold_roles(spark, params):
    arts = articles(spark, {"a": 100, "b": 57, "c": 11, "d": 3, "e": 1})
    docs, roles = fold_segments(arts, params)
    got = {(r.topic, r.doc_id, r.fold): r.role for r in docs.join(roles, ["topic", "segment"]).collect()}
    want = {(r.topic, r.doc_id, r.fold): r.role for r in fold_roles(arts, params).collect()}
    assert got == want and len(got) == docs.join(roles, ["topic", "segment"]).count()


def null_of(spark, sizes):
    rows = [(t, i, RND.randint(10, 14), round(RND.gauss(8, 2), 1 if t == "a" else 9)) for t, n in sizes.items() for i in range(n) for _ in range(RND.randint(0, 6))]
    return spark.createDataFrame(rows, "topic string, doc_id long, length int, x double")


@pytest.mark.parametrize("params", [Params(k_folds=4, grid_points=9), Params(k_folds=3, grid_points=5, window_size=2)])
def test_fold_grids_from_segment_counts_equal_grids_of_exploded_atoms(spark, params):
    sizes = {"a": 60, "b": 23, "c": 4}
    arts, null = articles(spark, sizes), null_of(spark, sizes).cache()
    docs, roles = fold_segments(arts, params)
    counts = segment_counts(null.join(docs, ["topic", "doc_id"]), ["topic"])
    one = fit_fold_grids(counts, roles, params)
    exploded = null.join(fold_roles(arts, params).where("role = 'null'"), ["topic", "doc_id"]).select("topic", "fold", "length", "x")
    many = fit_null_grid(exploded, params, ["topic", "fold"])
    key = ["topic", "fold", "length", "g"]
    a = {tuple(r[c] for c in key): (r.xg, r.z, r.lmin, r.lmax) for r in one.collect()}
    b = {tuple(r[c] for c in key): (r.xg, r.z, r.lmin, r.lmax) for r in many.collect()}
    assert set(a) == set(b) and len(a) > 100
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_null_atoms_are_not_dealt_to_folds(spark):
    """The counts know nothing of folds, and ``fit_fold_grids`` deals only sums by (segment, length, cells)."""
    sizes = {"a": 30}
    docs, _ = fold_segments(articles(spark, sizes), Params(k_folds=4))
    stored = spark.createDataFrame(docs.select("topic", "doc_id", "segment").collect(), "topic string, doc_id long, segment int")
    counts = segment_counts(null_of(spark, sizes).join(stored, ["topic", "doc_id"]), ["topic"])
    assert "fold" not in counts.columns and "fold" not in plan_of(counts)


def sentences(spark, n_docs=12):
    rows = []
    for d in range(n_docs):
        for pos in range(RND.randint(1, 30)):
            words = lambda: " ".join(["w"] * RND.choice([3, 10, 12, 40, 101]))
            rows.append(("t", d, pos, words(), words() if RND.random() < 0.5 else None))
    return spark.createDataFrame(rows, "topic string, doc_id long, pos int, sentence string, alternative string")


def test_settings_of_one_scan_equal_separate_runs(spark):
    s = sentences(spark).cache()
    settings = [Setting(0, None, None), Setting(0, None, 5), *(Setting(1, r, m) for r in (0.1, 0.3, None) for m in (None, 5, 8))]
    atoms = atoms_of(candidate_atoms(s, Params()), settings).drop("text").collect()
    for i, x in enumerate(settings):
        want = article_atoms(s, Params(edit_ratio=x.edit_ratio, max_sentences=x.max_sentences), versions=(x.edited,)).collect()
        key = lambda r: (r.doc_id, r.pos, r.kind, r.length, r.tag, r.atom_no, r.edited)
        assert sorted(map(key, want)) == sorted(key(r) for r in atoms if r.setting == i)


def survival(values, x):
    below, above = [v for v in values if v <= x], [v for v in values if v > x]
    if not values:
        return None
    if not below:
        return 1.0
    if not above:
        return 1 / len(values)
    lo, hi, n = max(below), min(above), len(values)
    zlo = -math.log((len(above) + values.count(lo)) / n)
    zhi = -math.log(len(above) / n)
    return min(1.0, math.exp(-((zhi - zlo) / (hi - lo) * (x - lo) + zlo)))


@pytest.mark.parametrize("range_values", [3, 50, 10_000])
def test_exact_pvalues_by_ranges(spark, range_values):
    null = [(f, n, round(RND.gauss(0, 1), d)) for f in (0, 1) for n, d in ((10, 1), (11, 9), (12, 0)) for _ in range(200)] + [(0, 13, 5.0)]
    ask = [(i, RND.choice([0, 1]), RND.choice([10, 11, 12, 13, 14, None]), RND.choice([round(RND.gauss(0, 1.5), 1), RND.gauss(0, 2), -99.0, 99.0, None, 5.0]))
           for i in range(600)]
    got = {r.atom_no: r.pvalue for r in exact_pvalue(
        spark.createDataFrame(ask, "atom_no int, fold int, eff_length int, response double"),
        spark.createDataFrame(null, "fold int, length int, x double"), ["fold"], id_cols=("atom_no",), range_values=range_values, bucket_rows=300).collect()}
    assert len(got) == len(ask)
    for i, f, n, x in ask:
        want = None if n is None or x is None else survival([v for g, m, v in null if (g, m) == (f, n)], x)
        assert got[i] == pytest.approx(want, abs=1e-12) if want is not None else got[i] is None


def test_grid_lookup_is_one_join(spark):
    null = spark.createDataFrame([(0, RND.randint(10, 15), RND.gauss(0, 1)) for _ in range(500)], "fold int, length int, x double")
    grid = fit_null_grid(null, Params(grid_points=9), ["fold"])
    grid.write.mode("overwrite").format("noop").save()
    stored = spark.createDataFrame(grid.collect(), grid.schema)
    pts = spark.createDataFrame([(0, n, 0.3) for n in (None, 2, 10, 12, 15, 60)], "fold int, eff_length int, response double")
    out = grid_pvalue(pts, stored, ["fold"], lengths=(10, 50))
    assert plan_of(out).count("Join ") == 1
    wide = grid_pvalue(pts, stored, ["fold"])
    p = {r.eff_length: r.pvalue for r in wide.collect()}
    assert p[2] == p[10] and p[60] == p[15] and p[None] is None and 0 < p[12] <= 1
    assert {r.eff_length: r.pvalue for r in out.where("eff_length BETWEEN 10 AND 15").collect()} == {k: p[k] for k in (10, 12, 15)}


def brute_sweep(rows, step, max_fpr):
    mn, mx = min(x for x, _ in rows), max(x for x, _ in rows)
    best, t = None, 0
    while mn + t * step < mx:
        th = mn + t * step
        tp, fp = sum(y for x, y in rows if x >= th), sum(1 - y for x, y in rows if x >= th)
        P, N = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        acc, fpr = (tp + N - fp) / len(rows), fp / N if N else None
        if acc > 0 and (max_fpr is None or (fpr is not None and fpr <= max_fpr)) and (best is None or acc > best[0]):
            best = (acc, th)
        t += 1
    return mx if best is None else best[1]


@pytest.mark.parametrize("max_fpr", [None, 0.05, 0.3])
def test_sparse_sweep_equals_every_step(spark, max_fpr):
    rows = [(k, round(RND.gauss(y, 1), 2), y) for k in range(6) for y in [RND.randint(0, 1) for _ in range(40)]] + [(6, 2.0, 1), (7, 1.0, 0), (7, 1.5, 0)]
    got = {r.k: r.threshold for r in threshold_sweep(spark.createDataFrame(rows, "k int, x double, y int"), "y", "x", ["k"], 0.05, max_fpr).collect()}
    for k in range(8):
        assert got[k] == pytest.approx(brute_sweep([(x, y) for g, x, y in rows if g == k], 0.05, max_fpr), abs=1e-9)


def test_sweeps_over_a_billion_steps(spark):
    rows = [(0.0, 0), (1.0, 0), (5e6, 0), (9e6, 1), (1e7, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    assert threshold_sweep(df, "y", "x", step=0.01, max_fpr=None).first().threshold == pytest.approx(5e6 + 0.01, abs=0.02)
    assert threshold_sweep(df, "y", "x", step=0.01, max_fpr=0.0).first().threshold == pytest.approx(5e6 + 0.01, abs=0.02)
    assert null_threshold(df.where("y = 0"), "x", step=0.001, alpha=0.4).first().threshold == pytest.approx(1.0, abs=0.01)
    assert null_threshold(df, "x", step=0.01, alpha=0.0).first().threshold == -1.0


def test_one_atoms_scan_and_one_scoring_for_all_settings(spark, monkeypatch):
    from authorscan.plans import experiments as X
    from tests.conftest import SF001

    calls = {"scan": 0, "score": 0}
    candidate, score = X.candidate_atoms, X.score_bigram

    def count(name, f):
        def run(*a, **k):
            calls[name] += 1
            return f(*a, **k)
        return run

    monkeypatch.setattr(X, "candidate_atoms", count("scan", candidate))
    monkeypatch.setattr(X, "score_bigram", count("score", score))
    corpus = X.Corpus(spark, SF001)
    acc = X.accuracy_run(corpus, Params())
    power = X.power_run(corpus, Params(), sizes=(5, 10))
    assert acc["summary"].count() > 0 and power["summary"].count() > 0 and calls == {"scan": 1, "score": 1}
    ds = acc["doc_scores"]
    assert ds.groupBy("edit_ratio").count().count() == 3
    per = ds.where("edited = 0").groupBy("topic", "fold", "doc_id").agg(F.count_distinct("HC").alias("n"), F.count("*").alias("m")).collect()
    assert all(r.n <= 1 and r.m == 3 for r in per)  # an original's result is the same under every ratio
