"""Keyed logistic regression: every (key, fold) reaches the optimum of sum(log-loss) + 0.5 ||w||^2 with a free
intercept (the published classifier's defaults), solved here by a plain Newton iteration in numpy."""

import random

import numpy as np
import pytest

from authorscan.operators.classify import TEST, TRAIN, VALIDATION, fold_parts, lor_cv, read_embedding_pairs
from authorscan.params import Params


def _rows(seed=0, keys=(("a", 0.05), ("a", 0.1), ("b", 0.05)), n=60, d=4):
    rng = np.random.default_rng(seed)
    out = []
    for j, (topic, ratio) in enumerate(keys):
        x = rng.normal(size=(n + 7 * j, d))
        y = (x @ rng.normal(size=d) * 2 + 0.3 + rng.normal(size=len(x)) > 0).astype(int)
        out += [(topic, ratio, i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    random.Random(1).shuffle(out)
    return out


SCHEMA = "topic string, edit_ratio double, vec_id long, edited int, features array<double>"


def newton(x, y):
    z = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        d = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + reg, z.T @ (p - y) + reg @ w)
        w -= d * min(1.0, 5 / max(np.abs(d).max(), 1e-12))
    return w


def test_every_key_and_fold_reaches_its_optimum(spark):
    rows = _rows()
    p = Params(k_folds=4)
    got = lor_cv(spark.createDataFrame(rows, SCHEMA).repartition(5), p)
    by = {(r[0], r[1], r[2]): r for r in rows}
    parts = {(r.topic, r.edit_ratio, r.vec_id): r.parts for r in got["parts"].collect()}
    assert set(parts) == set(by)
    models = {(r.topic, r.edit_ratio, r.fold): r.w for r in got["models"].collect()}
    assert len(models) == 3 * 4
    for (topic, ratio, fold), w in models.items():
        train = [by[k] for k, v in parts.items() if k[:2] == (topic, ratio) and v[fold] == TRAIN]
        want = newton(np.array([r[4] for r in train]), np.array([r[3] for r in train]))
        assert np.allclose(w, want, atol=1e-6)
    for r in got["predictions"].collect():
        x = np.array([*by[(r.topic, r.edit_ratio, r.vec_id)][4], 1.0])
        assert r.proba == pytest.approx(1 / (1 + np.exp(-x @ np.array(models[(r.topic, r.edit_ratio, r.fold)]))), abs=1e-9)
        assert r.part == ("test" if parts[(r.topic, r.edit_ratio, r.vec_id)][r.fold] == TEST else "validation")
    s = got["summary"].collect()
    assert {(r.topic, r.edit_ratio) for r in s} == {("a", 0.05), ("a", 0.1), ("b", 0.05)} and all(r.accuracy > 0.6 for r in s)


def test_parts_are_blocks_and_a_shuffled_split(spark):
    import hashlib

    rows = _rows(n=53)
    p = Params(k_folds=5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.topic, r.edit_ratio, r.vec_id): (r.edited, r.parts) for r in fold_parts(df, p, ["topic", "edit_ratio"], "vec_id").collect()}
    for key in {r[:2] for r in rows}:
        mine = {r[2]: r[3] for r in rows if r[:2] == key}
        block = {}
        for y in (0, 1):
            ids = sorted(i for i in mine if mine[i] == y)
            block |= {i: n * 5 // len(ids) for n, i in enumerate(ids)}
        for fold in range(5):
            rest = sorted((i for i in mine if block[i] != fold), key=lambda i: (hashlib.md5(f"{i}|555".encode()).hexdigest(), i))
            train = set(rest[:int(len(rest) * 0.8)])
            for i in mine:
                assert got[(*key, i)][1][fold] == (TEST if block[i] == fold else TRAIN if i in train else VALIDATION)


def test_one_class_and_missing_rows(spark):
    rows = [("c", 0.1, i, 0, [float(i), 1.0]) for i in range(12)] + [("c", 0.1, 99, 1, None), (None, 0.1, 98, 1, [1.0, 2.0])]
    got = lor_cv(spark.createDataFrame(rows, SCHEMA), Params(k_folds=3))
    pred = got["predictions"].collect()
    assert {r.vec_id for r in pred} == set(range(12)) and all(r.proba < 1e-9 and r.pred == 0 for r in pred)
    s = got["summary"].first()
    assert s.accuracy == 1.0 and s.FPR == 0.0
    assert lor_cv(spark.createDataFrame([], SCHEMA), Params(k_folds=3))["summary"].count() == 0


def test_from_a_file_pair_to_the_report(spark, tmp_path):
    rows = _rows(keys=(("news", 0.1), ("wiki", 0.15)), n=40, d=3)
    files = {}
    for topic, ratio, i, y, x in sorted(rows, key=lambda r: r[2]):
        files.setdefault((topic, ratio, y), []).append(x)
    for (topic, ratio, y), xs in files.items():
        d = tmp_path / topic / f"edit_ratio_{ratio}"
        d.mkdir(parents=True, exist_ok=True)
        head = "name,dim_0,dim_1,dim_2\n"
        (d / f"{topic}_embedded_{'edited' if y else 'not_edited'}.csv").write_text(
            head + "".join(f"a{i},{','.join(map(repr, x))}\n" for i, x in enumerate(xs)))
    got = read_embedding_pairs(spark, [f"{tmp_path}/{t}/edit_ratio_{r}/*.csv" for t, r in {k[:2] for k in files}])
    read = {(r.topic, r.edit_ratio, r.edited, r.row): r.features for r in got.collect()}
    assert read == {(*k, i): x for k, xs in files.items() for i, x in enumerate(xs)}
    report = lor_cv(got, Params(k_folds=4), id_col="row")["summary"].collect()
    assert {(r.topic, r.edit_ratio, r.model, r.statistics) for r in report} == {
        ("news", 0.1, "logistic_regression", "embedding"), ("wiki", 0.15, "logistic_regression", "embedding")}
