"""Boosted trees on small frames of their own, with small explicit sizes."""

from __future__ import annotations

import numpy as np
import pytest

from skysieve import contracts as C
from skysieve.operators import boosting as B
from skysieve.operators import learning as M
from skysieve.sources import artifacts as A

TASK = C.Task("demo", "kind", ("p", "q"), ("kind",))


def points(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2)).round(3)
    return x, np.where(x[:, 0] ** 2 + x[:, 1] ** 2 < 0.4, 0, np.where(x[:, 0] < 0, 1, 2))


def frame(spark, x, y):
    rows = [(i, float(a), float(b), "abc"[k]) for i, ((a, b), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "source_id long, p double, q double, kind string")


def brute_first_cut(x, grad, hess, least):
    """The best single cut over all features and values."""
    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = sum(grad[s].sum() ** 2 / hess[s].sum() for s in (left, ~left))
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


def test_first_cut_and_leaf_values_equal_brute_force():
    x, y = points(200)
    x = x.round(1)
    grad, hess = (0.3 - (y == 0)).astype(float), np.full(len(y), 0.21)
    (feature, cut, left, right, value), depth, added = B._Grower(x, 2, None, 20).tree(grad, hess, 0.1)
    _, f, at = brute_first_cut(x, grad, hess, 20)
    assert depth == 1 and feature[0] == f and cut[0] == pytest.approx(at)
    side = x[:, f] <= at
    for rows, leaf in ((side, left[0]), (~side, right[0])):
        assert value[leaf] == pytest.approx(-0.1 * grad[rows].sum() / hess[rows].sum())
        assert np.allclose(added[rows], value[leaf])


def test_trees_walked_one_row_at_a_time_give_the_same_scores():
    x, y = points()
    forest = B.train(x, y, np.ones(len(y)), 3, M.ModelSpec(iterations=8, leaves=7))
    raw = np.tile(forest.base, (50, 1))
    for i in range(50):
        for t in range(len(forest.feature)):
            at = 0
            while forest.left[t][at] != at:
                at = (forest.left if x[i, forest.feature[t][at]] <= forest.cut[t][at] else forest.right)[t][at]
            raw[i, t % 3] += forest.value[t][at]
    assert np.allclose(raw, forest.raw(x[:50])) and len(forest.feature) == 24
    again = B.Forest.from_bytes(forest.to_bytes())
    assert np.array_equal(again.probabilities(x), forest.probabilities(x))


@pytest.mark.parametrize("classes, leaves", [(2, 2), (3, 31), (2, 32), (3, 33), (3, 64), (2, 65)])
def test_leaves_are_looked_up_without_a_walk(monkeypatch, classes, leaves):
    x, y = points(1500)
    forest = B.train(x, np.minimum(y, classes - 1), np.ones(len(y)), classes, M.ModelSpec(iterations=6, leaves=leaves, min_leaf_rows=2))
    odd = np.array([[np.nan, 0.1], [np.inf, -np.inf], [0.2, np.nan], [forest.cut[0][0], forest.cut[0][0]]])
    rows = np.vstack([x, odd])
    walked = forest.walked(rows)
    if leaves <= 64:
        monkeypatch.setattr(B.Forest, "walked", None)
    assert np.array_equal(forest.raw(rows), walked)  # to the last bit
    assert forest.raw(rows[:0]).shape == (0, len(forest.base))


def test_trees_of_one_leaf_are_looked_up():
    forest = B.train(np.zeros((30, 2)), np.arange(30) % 3, np.ones(30), 3, M.ModelSpec(iterations=3))
    assert np.array_equal(forest.raw(np.ones((4, 2))), forest.walked(np.ones((4, 2))))


def test_leaves_keep_the_least_number_of_rows_and_the_depth():
    x, y = points()
    grower = B._Grower(x, 31, 3, 40)
    (_, _, left, _, _), depth, added = grower.tree((0.3 - (y == 0)).astype(float), np.full(len(y), 0.21), 0.1)
    assert depth <= 3 and min(np.unique(added, return_counts=True)[1]) >= 40 and (left != np.arange(61)).sum() <= 7


@pytest.mark.parametrize("classes", [2, 3])
def test_fit_and_score_held_out_rows(spark, tmp_path, classes):
    x, y = points(1500)
    y = np.minimum(y, classes - 1)
    spec = M.ModelSpec(iterations=30, sample_rows=300)
    model = M.fit(frame(spark, x[:1000], y[:1000]), TASK, spec)
    held = frame(spark, x[1000:], y[1000:])
    got = {r.source_id: r for r in M.score(held, model).collect()}
    assert np.mean([r.predicted_kind == r.kind for r in got.values()]) > 0.9
    assert all(abs(sum(r[c] for c in model.probability_columns.values()) - 1) < 1e-9 for r in got.values())
    assert len(model.forest.base) == (1 if classes == 2 else 3)
    A.save_model(spark, model, str(tmp_path / "m"))
    again = M.score(held, A.load_model(spark, str(tmp_path / "m"))).collect()
    assert {r.source_id: r for r in again} == got
    assert M.fit(frame(spark, x[:1000], y[:1000]).repartition(5), TASK, spec).forest.to_bytes() == model.forest.to_bytes()


def test_folds_in_order_whatever_ends_first(spark):
    x, y = points(600)
    protocol = C.Protocol(folds=3)
    df = frame(spark, x, y)
    means = M.cross_validate(df, TASK, M.ModelSpec(iterations=5), protocol)
    assert 0.8 < means["mean_accuracy"] <= 1
    held = M.out_of_fold(df, TASK, M.ModelSpec(iterations=5), "a", protocol)
    assert held.count() == held.select("source_id").distinct().count() == 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_scored_once_for_all_metrics(spark, monkeypatch):
    x, y = points(600)
    df = frame(spark, x, y).selectExpr("*", "CASE WHEN source_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_name")
    monkeypatch.setattr(type(df), "persist", None)  # a fit of trees reads its rows once
    model = M.fit(df, TASK, M.ModelSpec(iterations=4))
    got = M.evaluate(df, model)
    assert "ArrowEvalPython" in plan_of(M.score(df, model)) and "ArrowEvalPython" not in plan_of(got)
    called = {r.source_id: r.predicted_kind for r in M.score(df, model).collect()}
    for r in got.collect():
        mine = [i for i in range(600) if (i % 3 == 0) == (r.split_name == "test")]
        assert r.n_rows == len(mine) and r.accuracy == sum(called[i] == "abc"[y[i]] for i in mine) / len(mine)


def test_importance_scores_unswapped_rows_once(spark, monkeypatch):
    x, y = points(400)
    df = frame(spark, x, y)
    model = M.fit(df, TASK, M.ModelSpec(iterations=4))
    got = M.permutation_importance(df, model, repeats=3, positive="a")
    assert "ArrowEvalPython" not in plan_of(got)
    right = [(r.predicted_kind == "a") == (r.kind == "a") for r in M.score(df, model).collect()]
    assert {(r.metric_name, r.feature_name) for r in got.collect()} == {(m, f) for m in ("accuracy", "balanced_accuracy") for f in "pq"}
    assert all(r.importance_mean <= np.mean(right) for r in got.where("metric_name = 'accuracy'").collect())


def ordered(x, y):
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def test_all_rows_of_a_large_class_are_fitted(spark):
    """More than 4,000 rows of one class, which is where a sample was drawn before."""
    x, y = points(6000)
    y = (y > 0).astype(int)
    assert np.bincount(y)[1] > 4000
    spec = M.ModelSpec(iterations=2, leaves=5)
    got = M.fit(frame(spark, x, y), TASK, spec).forest
    assert got.to_bytes() == B.train(*ordered(x, y), np.ones(len(y)), 2, spec).to_bytes()


@pytest.mark.parametrize("classes, digits", [(3, 1), (3, 6), (2, 3)])
def test_many_tasks_grow_the_trees_of_one(spark, monkeypatch, classes, digits):
    rng = np.random.default_rng(3)
    x = np.vstack([points(2900)[0], rng.normal(0, 0.05, (100, 2))]).round(digits)
    y = np.minimum(np.where((x**2).sum(axis=1) < 0.4, 0, np.where(x[:, 0] < 0, 1, 2)), classes - 1)
    spec = M.ModelSpec(iterations=4, leaves=9, min_leaf_rows=5)
    monkeypatch.setattr(B, "FIT_ROWS", 900)
    monkeypatch.setattr(B, "SHARE", 900)  # four tasks
    monkeypatch.setattr(B, "PART", 64)
    monkeypatch.setattr(B, "CELLS", 20)
    monkeypatch.setattr(B, "IN_MEMORY", 1000)
    got = M.fit(frame(spark, x, y), TASK, spec).forest
    want = B.train(*ordered(x, y), np.ones(len(y)), classes, spec)
    for name in ("feature", "cut", "left", "right", "depth"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    assert np.allclose(got.base, want.base) and np.allclose(got.value, want.value, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(B, "SHARE", 1400)  # three tasks: the same to the last bit
    assert M.fit(frame(spark, x, y).repartition(5), TASK, spec).forest.to_bytes() == got.to_bytes()


@pytest.mark.parametrize("n", [256, 257, 300, 511, 513, 1000])
def test_cuts_come_from_all_rows(spark, monkeypatch, n):
    monkeypatch.setattr(B, "CELLS", 12)
    rng = np.random.default_rng(n)
    x = np.stack([rng.permutation(n).astype(float), rng.normal(0, 9, n), rng.integers(0, 7, n), np.where(rng.random(n) < 0.7, 3.0, rng.random(n))], axis=1)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    for got, column in zip(B.edges_of_all(rows, 4, n), x.T):
        assert np.array_equal(got, B.bin_edges(column))
