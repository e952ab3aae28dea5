"""File round trips (S1 S2 S6 S11 S14 S16), the user scorer hook (M2) and streaming."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from authorscan.operators.lm import fit_bigram, score_with
from authorscan.operators.survival import fit_null_grid, null_sample
from authorscan.params import Params
from authorscan.sources import articles as A
from authorscan.sources.cache import read_score_cache
from authorscan.sources.sinks import write_report
from authorscan.streaming.detect_stream import start_detect_stream


def _mk(base, *parts):
    p = os.path.join(base, *parts)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    return p


def test_read_articles_csv_layout(spark):
    base = tempfile.mkdtemp(prefix="authorscan-art-")
    art = {"title": "T", "sub_titles": [{"sub_title": "S", "sentences": [
        {"sentence": "one two three", "alternative": "four \"five\" six"}, {"sentence": "seven"}]}]}
    for topic in ("geo", "wars"):
        with open(_mk(base, topic, "edit_ratio_0.1", f"{topic}.csv"), "w") as f:
            f.write("article_json\n")
            for _ in range(3):
                f.write('"' + json.dumps(art).replace('"', '""') + '"\n')
            f.write('"{not json"\n')
    good, bad = A.read_articles(spark, os.path.join(base, "*", "edit_ratio_*", "*.csv"))
    assert good.count() == 6 and bad.count() == 2
    assert {r.topic for r in good.select("topic").distinct().collect()} == {"geo", "wars"}
    assert {r.edit_ratio for r in good.select("edit_ratio").distinct().collect()} == {0.1}
    assert sorted(r.article_index for r in good.filter("topic = 'geo'").collect()) == [0, 1, 2]
    txt = A.render_articles(good.limit(1), edited=True, doc_keys=("topic",)).first().text
    assert txt == 'T\n\n==S==\nfour "five" six\none two three\nseven\n'
    flat = A.explode_articles(good, ("topic", "article_index"))
    assert flat.filter(F.col("alternative").isNotNull()).count() == 6


def test_score_cache_json(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="authorscan-cache-"), "c.json")
    with open(p, "w") as f:
        json.dump({"Hello world": 1.5, " 'Quoted' ": 2.0}, f)
    got = {r.sent_key: r.response for r in read_score_cache(spark, p).collect()}
    assert got == {"hello world": 1.5, "quoted": 2.0}
    assert read_score_cache(spark, "/nonexistent/cache.json", allow_missing=True).count() == 0 and read_score_cache(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        read_score_cache(spark, "/nonexistent/cache.json")
    with open(p, "w") as f:
        json.dump({"Hello world": 1.5, "hello WORLD ": 2.5}, f)
    with pytest.raises(ValueError):
        read_score_cache(spark, p)
    with open(p + "l", "w") as f:
        f.write("".join(json.dumps({"text": t, "response": r}) + "\n" for t, r in (("Hello world", 1.5), (" 'Quoted' ", 2.0))))
    assert {r.sent_key: r.response for r in read_score_cache(spark, p + "l", "jsonl").collect()} == got


def test_user_scorer_hook(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("x",)], "text string")

    def make():
        return lambda texts, ctx: [float(len(t)) for t in texts]

    got = sorted((r.text, r.response) for r in score_with(df, make).collect())
    assert got == [("a b c", 5.0), ("a b c", 5.0), ("x", 1.0)]


def test_report_sink(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="authorscan-rep-"), "results")
    write_report(spark.createDataFrame([("t", 0.5)], "topic string, accuracy double"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.first().accuracy == "0.5"


def test_detect_stream(spark):
    from tests.conftest import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    train = docs.filter("doc_id % 2 = 0")
    from authorscan.operators.corpus import split_sentences
    sents = split_sentences(train, ("doc_id",), "text")
    lm = fit_bigram(sents)
    from authorscan.operators.lm import score_bigram
    null = null_sample(score_bigram(sents.filter(F.col("length").between(10, 100)), lm).withColumn("_k", F.lit(1)), ["_k"])
    grid = fit_null_grid(null, Params(), ["_k"])
    base = tempfile.mkdtemp(prefix="authorscan-stream-")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(SF001)
    q = start_detect_stream(stream, lm, grid, Params(), os.path.join(base, "out"), os.path.join(base, "ck"))
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(base, "out"))
    assert out.count() > 0 and out.filter(F.col("HC").isNotNull()).count() > 0


def test_read_articles_power_layout(spark):
    base = tempfile.mkdtemp(prefix="authorscan-pow-")
    art = {"title": "T", "sub_titles": [{"sub_title": "S", "sentences": [{"sentence": "a b c"}]}]}
    for n, r in ((50, "0.1"), (100, "0.2")):
        with open(_mk(base, "News", f"{n}_sentences", r, "News.csv"), "w") as f:
            f.write("article_json\n" + '"' + json.dumps(art).replace('"', '""') + '"\n')
    good, bad = A.read_articles(spark, os.path.join(base, "*", "*_sentences", "*", "*.csv"), layout="power")
    got = sorted((r.topic, r.number_sentence, r.edit_ratio) for r in good.collect())
    assert got == [("News", 50, 0.1), ("News", 100, 0.2)] and bad.count() == 0


def test_pair_registry(spark, tmp_path):
    from authorscan.sources.pairs import load_registered, read_registered
    long = "One. Two. Three. Four. Five. Six. Seven. Eight. Nine. Ten. A. B. C. D. E."
    df = spark.createDataFrame([("m1", "h1", "train"), ("m2", "h2", "test"), (long, "h3", "test"), (long + " . ", "h4", "train")],
                               "generated_intro string, wiki_intro string, split string").coalesce(1)
    short = load_registered(df, "wiki-intro")
    assert sorted((r.id, r.human_text) for r in short.collect()) == [(0, "h1"), (1, "h4")]  # in the order of the rows
    whole = load_registered(df, "wiki-intro-long", long_form=True)
    assert "id" not in whole.columns and sorted(r.human_text for r in whole.collect()) == ["h3", "h4"]
    df.write.json(f"{tmp_path}/pairs")
    ranks = {r.id: r.shuffle_rank for r in read_registered(spark, "wiki-intro-long", f"{tmp_path}/pairs", "json", shuffle=True).collect()}
    import hashlib
    want = sorted(ranks, key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    assert ranks == {i: n for n, i in enumerate(want)}


def test_null_context_keeps_its_score(spark):
    from authorscan.operators.lm import fit_bigram, score_bigram

    rows = spark.createDataFrame([(1, "the cat sat", None), (2, "the dog sat", "a b"), (3, "the cat ran", None)],
                                 "id int, text string, context string")
    lm = fit_bigram(rows.select("text"))
    got = score_bigram(rows, lm, context_col="context").collect()
    assert len(got) == 3 and all(r.response is not None for r in got)


def test_hc_null_written_twice_is_read_once(spark, tmp_path):
    from authorscan.sources.sinks import write_hc_null

    df = spark.createDataFrame([("a", 0.4, 1), ("a", 0.4, 2), ("b", 0.2, 3)], "variant string, gamma double, n int")
    for _ in range(2):
        write_hc_null(df, str(tmp_path / "hc"))
    write_hc_null(df.where("variant = 'b'"), str(tmp_path / "hc"))
    assert spark.read.parquet(str(tmp_path / "hc")).count() == 3


def test_registered_pairs_need_their_split(spark):
    import pytest

    from authorscan.sources.pairs import PAIR_REGISTRY, load_registered

    name, (machine, human, _) = next((k, v) for k, v in PAIR_REGISTRY.items() if v[2])
    with pytest.raises(ValueError):
        load_registered(spark.createDataFrame([("m", "h")], [machine, human]), name)


def test_donors_are_of_another_language_and_dealt_evenly(spark):
    from authorscan.sources.articles import document_sentences, donor_pairs, fixture_article_sentences
    langs = ["en"] * 7 + ["de"] * 2 + [None] * 2
    docs = spark.createDataFrame([(i, f"S {i} a. S {i} b. S {i} c.", lang, "src") for i, lang in enumerate(langs)],
                                 "doc_id long, text string, lang string, source string")
    donor = {r["doc_id"]: r["donor_id"] for r in donor_pairs(docs).collect()}
    assert sorted(donor) == list(range(11))
    assert all(langs[a] != langs[b] for a, b in donor.items())
    uses = {d: sum(donor[i] == d for i in range(7)) for d in range(7, 11)}  # seven en documents on four donors
    assert sorted(uses.values()) == [1, 2, 2, 2]
    flat = fixture_article_sentences(document_sentences(docs), docs).collect()
    assert len(flat) == 33
    for r in flat:
        assert r["alternative"] == (f"S {donor[r['doc_id']]} b." if r["pos"] == 1 else None)
    alone = docs.filter("lang = 'en'")
    assert {r["donor_id"] for r in donor_pairs(alone).collect()} == {None}
    assert donor_pairs(docs.limit(0)).count() == 0


def test_keyed_bigram_models_equal_separate_models(spark):
    from authorscan.operators.lm import fit_bigram, ngram_counts, score_bigram
    train = spark.createDataFrame([("m1", "a b a b c"), ("m1", "b c"), ("m2", "a c a c"), ("m2", "x")], "model string, text string")
    rows = spark.createDataFrame([("m1", "a b c"), ("m2", "a b c"), ("m3", "a b c"), ("m2", None), ("m1", "a")],
                                 "model string, text string")
    keyed = fit_bigram(train, keys=("model",))
    got = {(r["model"], r["text"]): r["response"] for r in score_bigram(rows, keyed).collect()}
    for m in ("m1", "m2"):
        one = fit_bigram(train.filter(F.col("model") == m))
        want = {(r["model"], r["text"]): r["response"] for r in score_bigram(rows.filter(F.col("model") == m), one).collect()}
        assert {k: v for k, v in got.items() if k[0] == m} == want
        assert (sorted(map(tuple, ngram_counts(keyed).filter(F.col("model") == m).drop("model").collect()))
                == sorted(map(tuple, ngram_counts(one).collect())))
    assert got[("m1", "a b c")] != got[("m2", "a b c")]
    assert got[("m3", "a b c")] == 0.0  # a model without training text: N = V = 0
