"""Findings F1 to F4 (time): packed scoring by numbers in place of strings, key by key."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from authorscan.functions import text as X
from authorscan.operators import lm as L
from authorscan.operators import scan as SC


def made(n, seed=5, letters="abcdéf"):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 3)))
    return [" ".join(word() for _ in range(rnd.randint(1, 8))) for _ in range(n)]


def told(block, counts):
    c1, c2 = counts
    return {k: (part, int(c1[i + n]), int(c2[i + n])) for part, i, j, packed in block.lists() for n, k in enumerate(L._keys([packed]).to_pylist())}


def test_a_block_counts_words_and_pairs():
    texts = made(300)
    block = L._Block(pa.array(texts), 7)
    got = told(block, block.counts())
    words = Counter(w for t in texts for w in t.split())
    pairs = Counter(" ".join(p) for t in texts for p in zip(t.split(), t.split()[1:]))
    firsts = Counter(u for t in texts for u in t.split()[:-1])
    assert {k: v[1:] for k, v in got.items()} == {**{w: (n, firsts[w]) for w, n in words.items()}, **{p: (n, 0) for p, n in pairs.items()}}
    assert len({v[0] for v in got.values()}) == 7


def test_a_key_has_one_part():
    """Whatever block it stands in, and whatever numbers its words have there."""
    a, b = (L._Block(pa.array(t), 7) for t in (made(200, 1), made(200, 2)))
    of_a, of_b = (told(x, x.counts()) for x in (a, b))
    assert len(shared := set(of_a) & set(of_b)) > 50 and all(of_a[k][0] == of_b[k][0] for k in shared)
    assert L._hashes(pa.array(["", "a", "ab", "ba", "a"])[1:]).tolist() == [L._hashes(pa.array([w]))[0] for w in ("a", "ab", "ba", "a")]


def test_distinct_numbers():
    rng = np.random.default_rng(2)
    for n, below in ((0, 1), (1, 5), (5000, 300), (5000, 1 << 45), (50, 1 << 60)):
        values = rng.integers(0, below, n)
        got, at = L._distinct(values, below)
        want, where = np.unique(values, return_inverse=True)
        assert got.tolist() == want.tolist() and at.tolist() == where.tolist()


def test_rows_of_a_model_in_blocks():
    """Blocks are cut inside a batch too, hold the rows of one model (NULL is one) and all of them."""
    rows = [(m, t, i) for i, (m, t) in enumerate(zip("xyz" * 100, made(300))) for m in [None if m == "z" else m]]
    rows = [(m, None if m is None else t, i) for m, t, i in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i:i + 70])], ["_model", "_t", "i"]) for i in range(0, 300, 70)]
    blocks = [(m, b.to_pylist()) for m, b in L._by_model(batches, 200, 10)]
    assert sorted(r["i"] for _, b in blocks for r in b) == list(range(300))
    assert all(r["_model"] == m for m, b in blocks for r in b)
    sizes = [sum(10 + len(r["_t"] or "") for r in b[:-1]) for _, b in blocks]  # without the row that fills it
    assert max(sizes) < 200 and len(blocks) > 20


def test_counts_take_the_bytes_that_they_need():
    small, large = np.array([1, 2, 3]), np.array([1 << 40, 0, 5])
    assert L._unzip_counts(L._zip_counts(small, large)).tolist() == [small.tolist(), large.tolist()]
    noise = np.random.default_rng(1).integers(0, 100, 10_000)
    assert len(L._zip_counts(noise, noise)) < 2 * 10_000 + 100 and (L._unzip_counts(L._zip_counts(noise, noise))[1] == noise).all()
    assert L._unzip_counts(L._zip_counts(np.array([127, 128]), np.array([32767, 32768])))[1].tolist() == [32767, 32768]


def test_texts_are_cut_into_words_as_python_does(spark):
    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "\u2003A\u00a0 b\u3000", "x\x1cy z", "a b c", "a   b  c", "é ü", "a\u1680b\u200bc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.joined_words("t").alias("j"), X.word_count("t").alias("n"), X.lm_text("t").alias("l"), X.lm_tokens("t").alias("tokens")).collect()
    for r in got:
        if r.t is None:
            assert (r.j, r.n, r.l) == (None, None, None)
        else:
            assert (r.j, r.n, r.l) == (" ".join(r.t.split()), len(r.t.split()), " ".join(r.tokens))


def test_a_list_is_worth_a_row(spark):
    """Packed lists (blocks times parts) stay few: 10 G characters make fewer than one list for 2,000 of them."""
    chars = 10 << 30
    assert (chars / L.BLOCK_CHARS) * (chars / L.PART_CHARS) < chars / 2000


def test_answers_have_every_key_once_asked():
    keys = lambda *k: L._joined(pa.array(k), [len(k)])[0]
    asked = pa.table({"_part": [0, 0, 0], "_block": ["a", "b", None], "_model": ["m"] * 3,
                      "k": [keys("p", "q", "p q"), keys("q", "z", L.TOTAL), L._zip_counts(np.array([9]), np.array([0]))]},
                     pa.schema([("_part", pa.int32()), ("_block", pa.string()), ("_model", pa.string()), ("k", pa.binary())]))
    model = L._packed_rows([(0, "m", keys("o", "p", "p q", "q"), L._zip_counts(np.array([7, 5, 2, 300]), np.array([1, 4, 0, 3])))])
    got = {r["_block"]: L._unzip_counts(r["c"]).tolist() for r in L._answer(asked, model).to_pylist()}
    assert got == {"a": [[5, 300, 2], [4, 3, 0]], "b": [[300, 0, 9], [3, 0, 0]]}
    none = L._answer(asked, model.slice(0, 0))
    assert [L._unzip_counts(r["c"]).tolist() for r in none.to_pylist()] == [[[0, 0, 0]] * 2, [[0, 0, 9], [0, 0, 0]]]


def test_all_tests_from_one_read(spark):
    """Documents without a p-value stay if they are asked for, as when their keys are given; a NULL key has no tests."""
    from authorscan.operators.detect import document_tests
    from authorscan.params import Params
    rnd = random.Random(3)
    rows = [(d, None if d == 7 or rnd.random() < 0.2 else rnd.choice((0.01, 0.2, 0.5, 1.0, rnd.random()))) for d in (*range(12), None) for _ in range(rnd.randint(1, 9))]
    pv = spark.createDataFrame(rows, "doc_id long, pvalue double")
    key = lambda df: sorted((str(r) for r in df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"}).collect()))
    own = document_tests(pv, ["doc_id"], Params(), documents=pv)
    given = document_tests(pv, ["doc_id"], Params(), documents=pv.select("doc_id").distinct())
    assert key(own) == key(given.select(own.columns)) and own.count() == 13
    empty = {r.doc_id: r for r in own.collect() if r.n_valid == 0}
    assert {7, None} <= set(empty) and all(v is None for r in empty.values() for k, v in r.asDict().items() if k not in ("doc_id", "n_valid"))
    assert key(document_tests(pv, ["doc_id"], Params())) == key(own.filter("n_valid > 0"))


def test_the_tests_of_a_round_read_its_rows(spark, monkeypatch):
    from authorscan.params import Params
    from authorscan.plans import experiments as E
    from tests.conftest import SF001
    monkeypatch.setattr(E, "ROUND_ROWS", 1)
    monkeypatch.setattr(E, "ROUNDS", 3)
    read, of = [], E.document_tests

    def tests(pv, *a, **kw):
        read.append(pv.count())
        return of(pv, *a, **kw)
    monkeypatch.setattr(E, "document_tests", tests)
    d = E.detect_folds(E.Corpus(spark, SF001), Params())
    d["tests"]
    assert len(read) == 3 and sum(read) == d["pvalues"].count()
    assert len(d["pvalues"].inputFiles()) > 0 and d["tests"].count() == d["pvalues"].select("topic", "fold", "doc_id", "setting").distinct().count()


def test_every_partition_of_a_scan_has_a_bucket(spark):
    for n in (1, 2, 7, 8, 12, 200):
        values = SC._bucket_values(n)
        assert values == sorted(set(values)) and len(values) == n
        got = spark.createDataFrame([(v,) for v in values], "v int").select(F.expr(f"pmod(hash(v), {n})")).distinct().count()
        assert got == n


def test_a_scan_over_all_rows_of_a_key(spark):
    rnd = random.Random(8)
    rows = [(k, i, None if k == "c" or rnd.random() < 0.2 else rnd.randint(0, 9)) for k, n in (("a", 90), ("b", 1), ("c", 9), (None, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    accs = [SC.Acc(f"{fn}_all", fn, "v", "all") for fn in ("sum", "min", "max")] + [SC.Acc("before", "sum", "v", "before")]
    for n in (1, 7):
        for r in SC.scan(df, ["k"], ["i"], accs, n).collect():
            mine = [v for k, _, v in rows if k == r.k and v is not None]
            assert (r.sum_all, r.min_all, r.max_all) == ((sum(mine), min(mine), max(mine)) if mine else (None,) * 3)
            assert (r.before or 0) == sum(v or 0 for k, i, v in rows if k == r.k and i < r.i)


def test_texts_are_made_once(spark, monkeypatch):
    """No condition makes the words of a text or its pieces a second time."""
    from authorscan.operators.corpus import split_sentences
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([("x", " "), ("x", "a b"), ("x", None), (None, "c d")], "m string, text string")
    seen = []
    with monkeypatch.context() as m:
        m.setattr(L, "cut_lineage", lambda df, *a, of=L.cut_lineage: (seen.append(plan(df)), of(df, *a))[1])
        lm = L.fit_bigram(df, keys=("m",))
    assert {r.w for r in lm.unigrams.collect()} == {"a", "b"}
    assert seen[0].count("lower(") == plan(df.select(X.lm_text("text").alias("t"))).count("lower(")
    assert plan(split_sentences(df, ("m",))).count("regexp_extract_all(") == 1


def test_the_lookup_deals_no_comments(spark):
    from authorscan.operators.detect import apply_length_policy, sentence_pvalues
    from authorscan.operators.survival import fit_null_grid
    from authorscan.params import Params
    rnd = random.Random(4)
    null = spark.createDataFrame([(f, rnd.randint(8, 60), rnd.gauss(8, 1)) for f in (0, 1) for _ in range(200)], "fold int, length int, x double")
    rows = [(i % 3, i, rnd.randint(5, 70), None if i % 7 == 0 else float("nan") if i % 11 == 0 else rnd.gauss(8, 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, atom_no int, length int, response double")
    for policy in ("max_available", "ignore", "truncate"):
        p = Params(grid_points=5, length_policy=policy)
        got = sentence_pvalues(df, fit_null_grid(null, p), p)
        want = {r.atom_no: (r.eff_length, r.comment) for r in apply_length_policy(df, p).collect()}
        assert got.columns == [*df.columns, "eff_length", "comment", "pvalue"]
        assert {r.atom_no: (r.eff_length, r.comment) for r in got.collect()} == want
        joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
        assert "below minimal" in joined[0] and "below minimal" not in joined[1]
