from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from skysieve.llm.factorisation import FACTORS, STATISTICS, Model, assemble, keep_good, quality_scores, scores, standardised
from skysieve.llm.toxicity import IDENTITY_FAMILIES, PAIRING, RIDGE, alike, features, fit, fit_weights, swapped, toxicity_scores, words_of

LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus(n=400, seed=0):
    """Every fourth text is toxic (marks around the words), every fifth is junk."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words += [rng.choice(["vilea", "vileb", "Nasty!!", "*nasty*"]) for _ in range(3)]
        rng.shuffle(words)
        text = " ".join(words) + "."
        if i % 5 == 0:
            text = rng.choice([" | ".join(words), "\n".join(words), "### ".join(words).upper() + "!!!"])
        rows.append((i, text))
        labels.append((i, int(i % 5 > 0), int(i % 4 == 0)))
    return rows, labels


ODD = [(5000, None), (5001, ""), (5002, "  \n"), (None, "word"), (3, "repeated id"), (5003, "nasty " * 20_000), (5004, "日本語 ｱ \x00")]


@pytest.mark.parametrize("operator, label", [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_held_out_accuracy_and_odd_rows(spark, docs_of, operator, label):
    rows, labels = corpus()
    marks = labels + [(1, None, None), (2, 7, 7), (None, 1, 1), (9, 0, 0), (99999, 0, 1)]
    docs = docs_of(rows + ODD).selectExpr("*", "1 as score", "'x' as metadata", "2 as y", "3 as held_out")
    got = operator(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == len(rows) + len(ODD)
    truth = {i: t if label == "toxic" else q for i, q, t in labels}
    right = [truth[r.doc_id] == r.predicted for r in got if r.doc_id in truth and r.doc_id != 3 and held(r.doc_id)]
    assert sum(right) >= 0.95 * len(right) > 100
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "toxic" else 0.5))
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))


@pytest.mark.parametrize("operator", [toxicity_scores, quality_scores])
def test_labels_of_one_class_or_none_and_empty_documents(spark, docs_of, operator):
    docs = docs_of([(0, "a"), (1, None)])
    free = next(i for i in range(99) if not held(i))
    for marks, want in (([], None), ([(free, 1, 1)], 1), ([(free, 0, 0)], 0)):
        got = operator(docs, spark.createDataFrame(marks, LABELS)).collect()
        assert len({r.score for r in got}) == 1 and len(got) == 2
        assert want is None or [r.predicted for r in got] == [want] * 2
    assert operator(docs_of([]), spark.createDataFrame(corpus()[1], LABELS)).collect() == []


def test_held_out_labels_are_not_learned(spark, docs_of):
    rows, labels = corpus(200)
    other = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    for operator in (toxicity_scores, quality_scores):
        a, b = (sorted(map(tuple, operator(docs_of(rows), spark.createDataFrame(m, LABELS)).collect())) for m in (labels, other))
        assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
        assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-9)


def test_rows_that_stay_keep_their_columns(spark, docs_of):
    rows, labels = corpus(300)
    docs, marks = docs_of(rows + ODD), spark.createDataFrame(labels, LABELS)
    good = sorted((r.doc_id for r in quality_scores(docs, marks).collect() if r.predicted), key=str)
    kept = keep_good(docs, marks)
    assert kept.schema == docs.schema and sorted((r.doc_id for r in kept.collect()), key=str) == good
    texts = {}
    for d, t in rows + ODD:
        texts.setdefault(d, set()).add(t)
    assert all(r.text in texts[r.doc_id] for r in kept.collect())


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    width, k = 50, len(STATISTICS)
    model = Model(0.3, rng.normal(size=width + k), rng.normal(size=(width + k, FACTORS)), np.zeros(k), np.ones(k))
    rows = [[1, 4, 9], [], list(range(40))]
    stats = standardised(rng.normal(size=(3, k)), model.mean, model.spread)
    starts, at, value = assemble(rows, stats, width)
    got = scores(model, starts, at, value)
    for i, edges in enumerate(zip(starts, [*starts[1:], len(at)])):
        mine = slice(*edges)
        a, x = at[mine], value[mine]
        want = model.bias + model.weights[a] @ x
        want += sum(model.factors[a[p]] @ model.factors[a[q]] * x[p] * x[q] for p in range(len(a)) for q in range(p))
        assert got[i] == pytest.approx(want)


def test_swaps_change_identity_terms_only():
    words = {"women", "walk", "muslim"}
    for new in swapped(words, key="k"):
        assert "walk" in new and not new & {"women", "muslim"} and len(new) == 3
        assert new & set(IDENTITY_FAMILIES[0]) and new & set(IDENTITY_FAMILIES[2])
    assert swapped({"walk"}) == [] and "^wome" in features({"women"})


def test_pairing_takes_weight_from_identity_terms():
    # the term is in most toxic texts of the sample, but says nothing by itself
    rng = np.random.default_rng(0)
    rows, labels, pairs, swaps = [], [], [], []
    for i in range(300):
        toxic = i % 2
        row = [0] * (rng.random() < (0.8 if toxic else 0.2)) + [2] * (rng.random() < (0.7 if toxic else 0.1))
        if 0 in row:
            pairs.append(i)
            swaps.append([1, *row[1:]])
        rows.append(row)
        labels.append(toxic)
    plain, _ = fit_weights(rows, labels, pairs, swaps, 3, 0.0, pairing=0.0)
    paired, _ = fit_weights(rows, labels, pairs, swaps, 3, 0.0, pairing=5.0)
    assert abs(paired[0] - paired[1]) < 0.35 * abs(plain[0] - plain[1]) and paired[2] > 1


def test_families_are_neutral_words_of_like_contexts():
    names = ["red", "blue", "walk", "green", "vile", "rare"]
    contexts = np.array([[90, 10, 0], [80, 12, 1], [0, 2, 95], [70, 9, 0], [85, 11, 0], [3, 0, 0]], float)
    assert alike(names, contexts, [True] * 4 + [False, True]) == [("red", "green", "blue")]  # the most alike first
    assert alike(names, contexts, [False] * 6) == [] and alike([], np.zeros((0, 0)), []) == []


def mentions(n=900, seed=4):
    """Two invented group names stand in like places; the first is in most toxic texts and in few others."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = [rng.choice(WORDS) for _ in range(30)]
        if rng.random() < 0.5:
            name = "zorba" if rng.random() < (0.62 if toxic else 0.45) else "quilda"
            words += ["with", name, "folk"] * 2
        if toxic and rng.random() < 0.7:
            words.append("vile")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_scores_equal_the_model_word_by_word_and_swaps_change_them_less(spark, docs_of):
    rows, labels = mentions()
    docs, marks = docs_of(rows), spark.createDataFrame(labels, LABELS)
    families = (("zorba", "quilda"),)
    model = fit(docs, marks, "toxic", 3, 1, 12_000, families)
    for r in toxicity_scores(docs, marks, families=families).collect():
        total = model.bias + sum(model.weights.get(f, 0.0) for f in features(words_of(rows[r.doc_id][1])))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    free = fit(docs, marks, "toxic", 3, 1, 12_000, families, pairing=0.0)
    gap = lambda m: abs(sum(m.weights.get(f, 0.0) * n for w, n in (("zorba", 1), ("quilda", -1)) for f in features({w})))
    assert gap(model) < 0.35 * gap(free)


def test_fit_reaches_the_loss_of_a_dense_minimisation():
    rng = np.random.default_rng(2)
    x = (rng.random((200, 6)) < 0.4).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(1 - 2 * x[:, 0] - x[:, 1]))).astype(float)
    pairs = np.flatnonzero(x[:, 1] > x[:, 2])
    z = x[pairs].copy()
    z[:, [1, 2]] = [0, 1]

    def loss(w):
        s = x @ w[:-1] + w[-1]
        return np.mean(np.log1p(np.exp(s)) - y * s) + RIDGE / 2 * w[:-1] @ w[:-1] + PAIRING * np.mean(((z - x[pairs]) @ w[:-1]) ** 2)

    def slope(w):
        s = x @ w[:-1] + w[-1]
        err, d = (1 / (1 + np.exp(-s)) - y) / len(y), z - x[pairs]
        return np.append(x.T @ err + RIDGE * w[:-1] + 2 * PAIRING * d.T @ (d @ w[:-1]) / len(d), err.sum())

    best = np.zeros(7)
    for _ in range(20_000):
        best -= 0.2 * slope(best)
    weights, bias = fit_weights([list(np.flatnonzero(r)) for r in x], y, pairs, [list(np.flatnonzero(r)) for r in z], 6, 0.0)
    assert loss(np.append(weights, bias)) <= loss(best) + 1e-3
