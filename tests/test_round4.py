"""Findings F2 to F23 (disk): text tables go when they have been read, scans deal rows once, scoring sends packed lists."""

import os
import random

from pyspark.sql import functions as F

from authorscan.operators.lm import fit_bigram, score_bigram
from authorscan.operators.scan import Acc, scan
from authorscan.params import Params
from authorscan.plans.experiments import Corpus, scored_candidates
from authorscan.session import cut_lineage, recorded_stages
from tests.conftest import SF001


def test_fit_and_scoring_leave_only_their_results(spark):
    rows = [(i, m, f"a b c {i % 7}") for i in range(50) for m in "xy"]
    df = cut_lineage(spark.createDataFrame(rows, "i int, model string, text string"))
    with recorded_stages() as written:
        lm = fit_bigram(df, keys=("model",))
    assert len(written) == 2  # the packed model and N + V + 1
    with recorded_stages() as written:
        got = score_bigram(df, lm, keep=["i"])
    assert len(written) == 1 and got.columns == ["i", "response"] and got.count() == 100


def test_model_tables_are_read_from_the_packed_model(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("xy"), " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 4)))) for _ in range(60)]
    lm = fit_bigram(spark.createDataFrame(rows, "model string, text string"), keys=("model",))
    toks = [(m, t.split()) for m, t in rows]
    want = {(m, w): sum(t.count(w) for k, t in toks if k == m) for m in "xy" for w in "abcd"}
    assert {(r["model"], r["w"]): r["c_w"] for r in lm.unigrams.collect()} == {k: n for k, n in want.items() if n}
    pairs = [(m, u, w) for m, t in toks for u, w in zip(t, t[1:])]
    assert {(r["model"], r["u"], r["w"]): r["c_uw"] for r in lm.bigrams.collect()} == {p: pairs.count(p) for p in pairs}
    firsts = [p[:2] for p in pairs]
    assert {(r["model"], r["u"]): r["c_u"] for r in lm.prefixes.collect()} == {p: firsts.count(p) for p in firsts}


def test_rows_come_back_with_repeats_and_nulls(spark):
    lm = fit_bigram(spark.createDataFrame([("a b a b c",)], "text string"))
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, "a"), (4, ""), (None, " a  b ")]
    got = score_bigram(spark.createDataFrame(rows, "i int, text string"), lm).collect()
    assert sorted((str(r["i"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    values = {r["response"] for r in got if r["text"] in ("a b", " a  b ")}
    assert len(values) == 1 and None not in values
    assert all(r["response"] is None for r in got if r["text"] in (None, "a", ""))


def test_windows_of_a_scan_deal_no_row_again(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "k int, i int")
    out = scan(df, ["k"], ["i"], [Acc("n", "sum", F.lit(1), "upto")], 4)
    assert "hashpartitioning(_pid" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert sorted((r["k"], r["i"], r["n"]) for r in out.collect()) == sorted((i % 3, i, i // 3 + 1) for i in range(60))


def test_scored_atoms_leave_no_table_of_texts(spark):
    with recorded_stages() as written:
        corpus = Corpus(spark, SF001)
        scored = scored_candidates(corpus, Params())
    for path, _ in written:
        assert not {"text", "sentence", "texts", "k"} & set(spark.read.parquet(path).columns)
    assert all(os.path.isdir(p.removeprefix("file:")) for p, _ in written)
    assert scored.filter(F.col("response").isNotNull()).count() > 0
    assert corpus.sentences().count() > 0  # built anew
