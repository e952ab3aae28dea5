"""Findings of round 3: linear scans, plain word splits, HC p-values of every tested document."""

import random
import re

from pyspark.sql import functions as F

from authorscan.functions.text import WS_CHARS, strip_ws, words
from authorscan.operators.scan import Acc, scan


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_scan_reads_no_frame_to_the_end_per_row(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([None, rnd.randint(-5, 5)]), rnd.choice([None, 0.5, 1.25])) for k in ("a", "b", None) for i in range(40)]
    rows += [("c", i, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, n int, x double")
    frames = ("upto", "before", "from", "after")
    got = scan(df, ["k"], ["i"], [Acc(f"{f}_{c}_{fn}", fn, c, f) for f in frames for c, fn in (("n", "sum"), ("x", "sum"), ("n", "max"))], 3)
    # the carry (_sc) has a few rows a partition; the cells' windows (_sl) read every row
    assert not re.search(r"(currentrow\$\(\)|1), unboundedfollowing\$\(\)\)\) AS _(sl|we)", _plan(got))
    test = {"upto": lambda i, j: j <= i, "before": lambda i, j: j < i, "from": lambda i, j: j >= i, "after": lambda i, j: j > i}
    for r in got.collect():
        for f in frames:
            inside = [q for q in rows if q[0] == r["k"] and test[f](r["i"], q[1])]
            n, x = [q[2] for q in inside if q[2] is not None], [q[3] for q in inside if q[3] is not None]
            assert (r[f"{f}_n_sum"], r[f"{f}_x_sum"], r[f"{f}_n_max"]) == (sum(n) if n else None, sum(x) if x else None, max(n, default=None))


def test_words_compile_no_pattern_per_row(spark):
    rnd = random.Random(5)
    letters = [*WS_CHARS, *"ab'.é​﻿⿿"]
    df = spark.createDataFrame([("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))),) for _ in range(2000)] + [(None,)], "t string")
    out = df.select("t", words("t").alias("w"), strip_ws("t").alias("s"))
    assert ",  , -1)" in _plan(out)  # split at one plain blank
    for r in out.collect():
        assert (r.w, r.s) == ((None, None) if r.t is None else (r.t.split(), r.t.strip()))


def test_hc_pvalue_has_every_tested_document(spark, tmp_path):
    from authorscan.plans.catalog import REGISTRY
    rnd = random.Random(7)
    text = lambda: " ".join(" ".join(rnd.choice("abcdefgh") for _ in range(12)) + "." for _ in range(8))
    spark.createDataFrame([(i, text(), "en" if i % 2 else "fr", "s") for i in range(60)], "doc_id long, text string, lang string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    keys = ["topic", "fold", "doc_id", "edited"]
    got = REGISTRY["hc_pvalue"].spark(spark, str(tmp_path))
    want = REGISTRY["doc_hc"].spark(spark, str(tmp_path))
    assert sorted(got.select(*keys).collect()) == sorted(want.select(*keys).collect())
    assert got.filter(F.col("HC_pvalue").isNotNull()).count() > 0


def test_scoring_deals_no_row_for_every_pair(spark):
    from collections import Counter
    from math import log

    from authorscan.operators.lm import fit_bigram, score_bigram
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9)))
    train, rows = [(m, text()) for m in "xy" for _ in range(30)], [(i, rnd.choice(["x", "y", "z", None]), rnd.choice([text(), None])) for i in range(200)]
    rows.append((200, "x", "unseen words only"))
    lm = fit_bigram(spark.createDataFrame(train, "model string, text string"), keys=("model",))
    got = score_bigram(spark.createDataFrame(rows, "i int, model string, text string"), lm)
    assert "Generate" not in _plan(got)
    have = {r["i"]: r["response"] for r in got.collect()}
    assert len(have) == len(rows)
    for i, m, t in rows:
        toks = (t or "").split()
        if m is None or len(toks) < 2:
            assert have[i] is None
            continue
        mine = [x.split() for k, x in train if k == m]
        uni, big = Counter(w for x in mine for w in x), Counter(p for x in mine for p in zip(x, x[1:]))
        pre = Counter()
        for (u, _), n in big.items():
            pre[u] += n
        denom = sum(uni.values()) + len(uni) + 1
        want = [-log((big[u, w] + 5 * (uni[w] + 1) / denom) / (pre[u] + 5)) for u, w in zip(toks, toks[1:])]
        assert abs(have[i] - sum(want) / len(want)) < 1e-8
