"""Article files, score store and run store: from a CSV tree and a JSON cache to the stored reports."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from authorscan.operators.lm import fit_bigram, score_bigram, with_cache
from authorscan.params import Params
from authorscan.plans.experiments import ArticleFiles, accuracy_run, power_run
from authorscan.session import checkpoint_dir
from authorscan.sources import articles as A
from authorscan.sources.cache import ScoreStore, read_score_cache
from authorscan.sources.runs import RunStore
from authorscan.sources.sinks import read_hc_null, write_hc_null

RND = random.Random(4)
WORDS = "the river runs far from old stone house near green field and grey sky".split()
ODD = "quark lattice vector meson lepton tensor gluon photon boson hadron".split()


def _sentence(words):
    return " ".join(RND.choice(words) for _ in range(RND.randint(10, 14))) + "."


def _articles(n):
    return [{"title": f"t{i}", "sub_titles": [{"sub_title": f"s{b}", "sentences": [
        {"sentence": _sentence(WORDS), **({"alternative": _sentence(ODD)} if RND.random() < 0.6 else {})} for _ in range(8)]} for b in range(2)]} for i in range(n)]


def _tree(root, layouts, n=20):
    made = {}
    for folder in layouts:
        d = root.joinpath(*folder.split("/"))
        d.mkdir(parents=True)
        made[folder] = _articles(n)
        rows = ['"' + json.dumps(a).replace('"', '""') + '"' for a in made[folder]]
        (d / "x.csv").write_text("\n".join(["article_json", *rows, ""]))
    return made


def _scorer(spark, cache):
    lm = fit_bigram(spark.createDataFrame([(" ".join(WORDS * 3),)], "text string"))
    return lambda atoms: with_cache(atoms, cache, lambda df: score_bigram(df, lm)).drop("from_cache", "sent_key")


def _leftovers(spark):
    root = checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    return set(glob.glob(f"{root}/stage-*")) | set(glob.glob(f"{root}/llm-*"))


def test_large_files_are_split_and_keep_their_order(spark, tmp_path):
    made = _tree(tmp_path, ["geo/edit_ratio_0.1", "war time/edit_ratio_0.15"], 120)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = A.read_articles(spark, f"{tmp_path}/*/*/*.csv")
        rows = good.collect()
        assert spark.read.option("header", True).csv(f"{tmp_path}/*/*/*.csv").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert bad.count() == 0 and len(rows) == 240
    for r in rows:
        want = made[f"{r.topic}/edit_ratio_{r.edit_ratio}"][r.article_index]
        assert r.article.title == want["title"] and r.article.sub_titles[0].sentences[0].sentence == want["sub_titles"][0]["sentences"][0]["sentence"]
    A.write_article_lines(good, f"{tmp_path}/lines")
    back, bad = A.read_articles(spark, f"{tmp_path}/lines/*/*/*", "lines", "jsonl")
    key = lambda r: (r.topic, r.edit_ratio, r.article_index)
    assert bad.count() == 0 and {key(r): r.article for r in back.collect()} == {key(r): r.article for r in rows}


def test_accuracy_run_from_files_and_a_json_cache(spark, tmp_path):
    made = _tree(tmp_path, ["geo/edit_ratio_0.1", "geo/edit_ratio_0.3", "war/edit_ratio_0.3"])
    known = {s["sentence"]: 3.0 + len(s["sentence"]) / 100 for a in made["geo/edit_ratio_0.1"] for b in a["sub_titles"] for s in b["sentences"]}
    (tmp_path / "cache.json").write_text(json.dumps(known))
    cache = read_score_cache(spark, str(tmp_path / "cache.json"))
    before = _leftovers(spark)
    store = RunStore(spark, str(tmp_path / "runs"))
    params = Params(k_folds=4, grid_points=9)
    counts = []
    for _ in range(2):  # the second run of the same id replaces the first
        with store.run("r1", params) as run:
            files = ArticleFiles(spark, f"{tmp_path}/*/edit_ratio_*/*.csv", _scorer(spark, cache), model="cache+bigram")
            got = accuracy_run(files, params)
            scores = run.write("doc_scores", got["doc_scores"])
            run.write("summary", got["summary"])
            run.write("hc_null", got["hc_null"])
            counts.append(scores.count())
    assert _leftovers(spark) == before
    scores = store.read("doc_scores", "r1")
    assert counts[0] == counts[1] == scores.count() > 0
    # per file 4 test blocks of 5 articles and their calibration rows, two versions each
    groups = {(r.topic, r.edit_ratio): r.n for r in scores.groupBy("topic", "edit_ratio").agg(F.count_distinct("doc_id").alias("n")).collect()}
    assert groups == {("geo", 0.1): 20, ("geo", 0.3): 20, ("war", 0.3): 20}
    assert {r.model for r in scores.select("model").distinct().collect()} == {"cache+bigram"}
    tested = scores.where("role = 'test' AND HC IS NOT NULL")
    assert tested.where("HC_pvalue IS NULL").count() == 0 and scores.where("role = 'calibration' AND HC_pvalue IS NOT NULL").count() == 0
    mean = {r.edited: r.hc for r in tested.groupBy("edited").agg(F.avg("HC").alias("hc")).collect()}
    assert mean[1] > mean[0] + 1  # planted edits are found
    assert set(scores.where("edited = 1").agg(F.max("edit_rate")).first()) != {0.0}
    summary = {(r.topic, r.edit_ratio, r.statistic): r for r in store.read("summary", "r1").collect()}
    assert len(summary) == 3 * 2 and all(r.model == "cache+bigram" for r in summary.values())
    runs = {r.table: r for r in store.runs().collect()}
    assert {t: r.rows for t, r in runs.items()} == {"doc_scores": counts[0], "summary": 6, "hc_null": runs["hc_null"].rows}
    assert json.loads(runs["summary"].params)["k_folds"] == 4
    plan = store.read("doc_scores").where("topic = 'geo' AND fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan


def test_power_run_from_files(spark, tmp_path):
    _tree(tmp_path, ["geo/5_sentences/0.2", "geo/9_sentences/0.2"])
    files = ArticleFiles(spark, f"{tmp_path}/*/*_sentences/*/*.csv", _scorer(spark, read_score_cache(spark, None)), "power")
    got = power_run(files, Params(k_folds=4, grid_points=9))
    summary = {(r.number_sentence, r.statistic): r for r in got["summary"].collect()}
    assert set(summary) == {(n, s) for n in (5, 9) for s in ("HC", "minP")}
    sizes = {r.number_sentence: r for r in got["atoms"].where("edited = 0").groupBy("number_sentence", "doc_id").count().groupBy("number_sentence").agg(
        F.max("count").alias("hi"), F.min("count").alias("lo")).collect()}
    assert sizes[5].hi == sizes[5].lo == 5 and sizes[9].hi == sizes[9].lo == 9


def test_a_run_that_fails_leaves_no_manifest_and_no_stages(spark, tmp_path):
    from authorscan.session import cut_lineage
    store, before = RunStore(spark, str(tmp_path / "runs")), _leftovers(spark)
    with pytest.raises(RuntimeError), store.run("bad") as run:
        run.write("t", cut_lineage(spark.range(3)))
        raise RuntimeError
    assert _leftovers(spark) == before and store.read("t", "bad").count() == 3
    with pytest.raises(FileNotFoundError):
        store.runs()


def test_the_second_run_scores_nothing(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"), buckets=4)
    seen = []

    def scorer(df):
        texts = [r.text for r in df.collect()]
        seen.append(sorted(texts))
        return df.withColumn("response", F.when(F.length("text") > 3, F.length("text").cast("double")))

    first = spark.createDataFrame([(1, "One two"), (2, "one TWO "), (3, "abcdef"), (4, "x"), (5, None)], "i int, text string")
    got = {r.i: r.response for r in store.score(first, scorer, "r1").collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 6.0, 4: None, 5: None} and seen == [["One two", "abcdef", "x"]]
    assert {r.i: r.response for r in store.score(first, scorer, "r2").collect()} == got and len(seen) == 1
    more = first.unionByName(spark.createDataFrame([(6, "new text"), (7, "abcdef")], "i int, text string"))
    got = {r.i: r.response for r in store.score(more, scorer, "r3").collect()}
    assert seen[1:] == [["new text"]] and got[6] == 8.0 and got[7] == 6.0 and store.read().count() == 4
    store.add(spark.createDataFrame([("new text", 9.0)], "sent_key string, response double"), "r3")  # a repeated run replaces its own rows
    assert {r.sent_key: r.response for r in store.read().collect()} == {"one two": 7.0, "abcdef": 6.0, "x": None, "new text": 9.0}


def test_hc_null_is_read_back_by_its_parameters(spark, tmp_path):
    schema = "fold int, length int, g int, xg double, z double, gamma double, variant string"
    write_hc_null(spark.createDataFrame([(0, 5, 0, -1.0, 0.0, 0.15, "2004")], schema), str(tmp_path / "h"))
    write_hc_null(spark.createDataFrame([(0, 5, 0, -1.0, 0.5, 0.3, "2008")], schema), str(tmp_path / "h"))
    assert [(r.z, r.gamma, r.variant) for r in read_hc_null(spark, str(tmp_path / "h"), "2008", 0.3).collect()] == [(0.5, 0.3, "2008")]
    with pytest.raises(ValueError):
        read_hc_null(spark, str(tmp_path / "h"), "2008", 0.15)


def test_own_splitter_and_truncated_scoring(spark):
    from authorscan.operators.corpus import split_sentences
    from authorscan.operators.detect import truncate_for_scoring
    docs = spark.createDataFrame([(1, "a|b b| |c")], "doc_id int, text string")
    got = split_sentences(docs, mode=lambda c: F.split(c, r"\|")).collect()
    assert [(r.pos, r.text, r.length) for r in got] == [(0, "a", 1), (1, "b b", 2), (3, "c", 1)]
    atoms = spark.createDataFrame([("a  b c d",)], "text string")
    assert truncate_for_scoring(atoms, Params(length_policy="truncate", max_len=3)).first().scored_text == "a b c"
    assert truncate_for_scoring(atoms, Params(max_len=3)).first().scored_text == "a  b c d"


def test_event_stream_equals_the_batch_and_drops_late_events(spark, tmp_path):
    import datetime as dt

    from authorscan.streaming.event_windows import event_null_grid, event_pvalues, start_event_stream, window_counts, window_tests
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=37 * i), RND.randint(0, 5), RND.choice(["view", "buy"]), round(RND.expovariate(0.1), 2)) for i in range(400)]
    late = (9998, start + dt.timedelta(minutes=5), 3, "view", 1e6)  # ten days behind the watermark by then
    end = (9999, start + dt.timedelta(days=40), 0, "view", 1.0)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    params = Params(grid_points=9)
    grid = event_null_grid(spark.createDataFrame(rows, schema), params)
    src = tmp_path / "in"
    for n, part in enumerate((rows[:200], rows[200:], [end], [late])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"{n}"))
    files = sorted(glob.glob(f"{src}/*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for n, f in enumerate(files):  # one file a trigger, in order
        (flat / f"{n}.parquet").write_bytes(open(f, "rb").read())
        stream = spark.readStream.schema(schema).parquet(str(flat))
        start_event_stream(stream, grid, params, out, ck).awaitTermination(300)
    got = spark.read.parquet(out)
    key = lambda r: (str(r.window_start), r.user_id, r.n_valid, round(r.HC, 9), round(r.fisher, 9), round(r.minP, 9))
    want = window_tests(window_counts(event_pvalues(spark.createDataFrame(rows, schema), grid)), params).collect()
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and len(want) > 30
