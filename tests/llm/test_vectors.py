"""Exact search and hard negatives against plain loops over all pairs, in Python's whole numbers."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorscan.llm import hard_negatives, topk_search, vectors

RNG = random.Random(3)
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rid int"


def _rows(width=12, n=400):
    base = [[RNG.gauss(0, 1) * RNG.choice([0.2, 1, 3]) for _ in range(width)] for _ in range(n // 2)]
    rows = [(i, RNG.choice(base), RNG.randrange(3)) for i in range(n)]  # many equal vectors
    rows += [(100, rows[100][1], 1), (100, rows[100][1], rows[100][2]), (500, None, 1), (600, [], 2), (700, [1.0, None] + [0.0] * 10, 1), (800, [math.nan] * width, 1),
             (900, [math.inf] + [0.0] * 11, 0), (1000, [1.0, -2.0], 0), (1100, [0.0] * width, 1), (None, rows[0][1], 1), (1200, rows[5][1], None),
             (-100, rows[7][1], 2), (1300, [1.0] * (width + 2), 2)]
    RNG.shuffle(rows)
    return rows


ROWS = _rows()


def _df(spark, rows=ROWS, n=3):
    out = spark.createDataFrame([(i, v, y, "clash", 4) for i, v, y in rows], SCHEMA)
    return out.repartition(n) if rows else out


def _whole(rows, scale):
    for i, v, y in rows:
        if i is None or v is None or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        yield i, [math.floor(scale * float(np.float32(x))) for x in v], y


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))  # noqa: B905


def brute_top(rows, every, k):
    all_ = list(enumerate(_whole(rows, 1024)))
    out = []
    for n, (q, v, _) in all_:
        if q % every == 0:
            best = sorted((-_dot(v, w), i) for m, (i, w, _) in all_ if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def brute_mine(rows, every):
    all_ = [(n, (i, v, (y + 1) % 10 if i % 7 == 0 else y)) for n, (i, v, y) in enumerate(_whole(rows, 256)) if y is not None]
    out = []
    for n, (a, v, y) in all_:
        if a % every:
            continue
        scored = sorted((-_dot(v, w), i, z == y) for m, (i, w, z) in all_ if m != n)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            some = [(i, -t) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(some)]
    return sorted(out)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("every", [100, 10])
def test_top_k(spark, every, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1200)
    got = topk_search.top_k(_df(spark), every)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(ROWS, every, 10)


def test_top_k_of_few_rows(spark):
    few = ROWS[:6] + [(200, [1.0] * 12, 0)]
    assert sorted(map(tuple, topk_search.top_k(_df(spark, few)).collect())) == brute_top(few, 100, 10)


def test_mine(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1200)
    got = hard_negatives.mine(_df(spark), label(), 10)
    assert sorted(map(tuple, got.collect())) == brute_mine(ROWS, 10)


@pytest.mark.parametrize("big", [2.0 ** 18, 2.0 ** 40])
def test_scores_that_no_double_or_long_holds_exactly(spark, big):
    rows = [(10 * i, [big * RNG.randint(-3, 3) + RNG.randint(-9, 9) for _ in range(4)], RNG.randrange(2)) for i in range(20)]
    cut = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = [(a, b, c, cut(s)) for a, b, c, s in brute_top(rows, 100, 10)]
    got = sorted(map(tuple, topk_search.top_k(_df(spark, rows)).collect()))
    assert [g[3] for g in got] == [w[3] for w in want] and (got == want or big > 2 ** 30)


def test_wide_components_through_the_tables():
    for size, dtype in ((200, np.int32), (1 << 24, np.int64), (1 << 40, object)):
        m = np.array([[float(RNG.randint(-size, size)) for _ in range(19)] for _ in range(30)])
        a = np.array([[float(RNG.randint(-size, size)) for _ in range(19)] for _ in range(5)])
        bits = hard_negatives.planes(m)
        assert hard_negatives.width_needed(a, bits.shape[0]) is dtype
        got = hard_negatives.lookup_scores(hard_negatives.tables(a, dtype), bits)
        assert [[int(s) for s in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for q in a] for r in m]


def test_partial_sums_prune_most_pairs_and_lose_none():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.normal(size=(2000, 32)) * 0.9 ** np.arange(32))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    block = vectors.Block(*[np.arange(2000)] * 3, np.zeros((2000, 0)), x)
    r = topk_search._Rotated.of(block, turn, [4, 8, 16])
    s = x[:20] @ x.T
    bound = np.sort(s, axis=1)[:, -10].astype(np.int64)
    i, j = topk_search.live_pairs(r, r, np.arange(20), bound, [4, 8, 16])
    live = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(a, b) for a, b in zip(*np.nonzero(s >= bound[:, None]), strict=True)} <= live and len(live) < 0.2 * s.size


def test_longest_vectors_come_first_and_later_blocks_are_skipped():
    near = vectors.Block(np.array([1, 2]), np.array([1, 2]), np.zeros(2), np.zeros((2, 0)), np.array([[9.0, 0], [8.0, 0]]))
    far = vectors.Block(np.array([3]), np.array([3]), np.zeros(1), np.zeros((1, 0)), np.array([[np.nan, 0]]))  # would spoil a score if it were read
    q = vectors.Block(np.array([0]), np.array([0]), np.zeros(1), np.array([[topk_search.LEAST]]), np.array([[1.0, 0]]))
    turn = np.eye(2)
    group = [topk_search._Rotated.of(b, turn, [1]) for b in (near, far)]
    group[1].length[:] = 1.0
    best = topk_search._search(group, topk_search._Rotated.of(q, turn, [1]), 2, [1])
    assert best.vec_id.tolist() == [1, 2] and best.score.tolist() == [9, 8]


def test_empty_tables(spark):
    assert topk_search.top_k(_df(spark, [])).count() == 0
    assert hard_negatives.mine(_df(spark, []), label()).count() == 0
    only = [(1, [1.0], 0), (2, [2.0], 1)]
    assert topk_search.top_k(_df(spark, only)).count() == 0 and hard_negatives.mine(_df(spark, only), label()).count() == 0
    alone = [(100, [1.0], 0)]
    assert topk_search.top_k(_df(spark, alone)).count() == 0 and hard_negatives.mine(_df(spark, alone), label()).count() == 0
    assert topk_search.top_k(_df(spark, [(100, [], 0), (5, [], 1)])).collect()[0].score == 0


def test_pairs_of_equal_rows_do_not_grow(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(0, 3000)]
    got = defaultdict(list)
    for r in topk_search.top_k(_df(spark, rows)).collect():
        got[r.query_id].append(r.vec_id)
    assert all(sorted(v) == [i for i in range(12) if i != q][:10] for q, v in got.items()) and len(got) == 30
