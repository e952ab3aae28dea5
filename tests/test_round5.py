"""Findings F3 to F22 (disk): shuffle files go, texts aren't joined, scoring and tests run in rounds."""

import random

from pyspark.sql import functions as F

from authorscan.operators import lm as L
from authorscan.operators.corpus import Setting, previous_context
from authorscan.params import Params
from authorscan.plans import experiments as X
from authorscan.session import SHUFFLE_CLEANUP, cut_lineage, recorded_stages, shuffles_removed
from authorscan.sources.cache import ScoreStore
from tests.conftest import SF001


def test_shuffle_files_are_removed(spark):
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    with shuffles_removed(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_rounds_of_a_scoring_give_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("xy"), " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9)))) for i in range(400)]
    df = cut_lineage(spark.createDataFrame(rows, "i int, model string, text string").repartition(4))
    lm = L.fit_bigram(df, keys=("model",))
    want = sorted(map(str, L.score_bigram(df, lm).collect()))
    lm.block_chars = 300
    with recorded_stages() as written:
        got = L.score_bigram(df, lm)
    assert len(written) == L.ROUNDS and sorted(map(str, got.collect())) == want


def test_the_model_is_not_dealt_again(spark):
    lm = L.fit_bigram(spark.createDataFrame([("a b c",), ("b c d",)], "text string"))
    own = spark.createDataFrame([(0, "x")], "_part int, x string")
    plan = (own.groupBy("_part").cogroup(lm.packed.groupBy("_part")).applyInArrow(lambda a, b: a.select(["x"]), "x string")
            ._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning(_part") == 1


def test_articles_are_joined_without_texts(spark):
    """The joins of articles, donors and contexts deal references; the scored texts are those of the flat articles."""
    corpus, p = X.Corpus(spark, SF001), Params()
    refs, s = corpus.references(), corpus.sentences()
    assert "text:string" not in refs._jdf.queryExecution().executedPlan().toString()
    of = {r.ref: r.text for r in s.collect()}
    assert len(of) == s.count()
    got = sorted((r.topic, r.doc_id, r.pos, of[r.sentence], of.get(r.alternative)) for r in refs.collect())
    assert got == sorted((r.topic, r.doc_id, r.pos, r.sentence, r.alternative) for r in corpus.flat_articles().collect())
    _, atoms, _ = corpus.referred(p, lambda *keys: None)
    assert atoms.count() == atoms.select("_ref", "model", "kind").distinct().count()


def test_contexts_by_reference(spark):
    corpus, p = X.Corpus(spark, SF001), Params()
    settings = [Setting(v, 0.15) for v in (0, 1)]
    keys = ("topic", "doc_id", "edited")
    atoms = previous_context(X.atoms_of(corpus.candidates(p), settings).select(*keys, "model", "atom_no", "text"), keys, "atom_no")
    want = L.score_bigram(atoms, corpus.lm(), context_col="context").select(*keys, "atom_no", "response")
    with recorded_stages() as written:
        got = X.context_scores(corpus, p, settings)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len(written) == 2  # the result and the corpus's articles


def test_tests_in_rounds_give_the_same(spark, monkeypatch):
    def run():
        d = X.detect_folds(corpus, Params(), (0.05, 0.15))
        with recorded_stages() as written:
            scores = d["doc_scores"]
        drop = [c for c in scores.columns if c in ("fisher", "HC", "fisher_pvalue", "minP", "bonf", "HC_pvalue")]
        return sorted(map(str, scores.withColumns({c: F.round(c, 6) for c in drop}).collect())), [set(spark.read.parquet(p).columns) for p, _ in written]
    corpus = X.Corpus(spark, SF001)
    want, _ = run()
    monkeypatch.setattr(X, "ROUND_ROWS", 1)
    got, stages = run()
    assert got == want and not any({"p", "m", "_pid"} <= c for c in stages)  # no ranged rows stay


def test_store_deals_no_text_to_look_up(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"), buckets=2)
    df = spark.createDataFrame([(1, "One two"), (2, "one TWO "), (3, None)], "i int, text string")
    scorer = lambda x: x.select("sent_key", F.lit(2.0).alias("response"))
    with recorded_stages() as written:
        got = store.score(df, scorer, "r1").select("i", "response")
    assert not written and {r.i: r.response for r in got.collect()} == {1: 2.0, 2: 2.0, 3: None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (_id" in plan
