"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the distinct words of a text and their first letters (which catch families of inflected words); the
ones most associated with the label are kept. In labelled texts that name a group of people, the identity terms are
swapped for others, and the fit adds the squared change of the score under each swap to its loss. A neutral mention
of a group then says nothing about the score, however the labels are distributed over groups.

Terms come in families: a table of fixed ones (`families`), and families learned from the texts of the sample, so that a
corpus in other words or languages is covered too. These are frequent words that stand next to the same words
and whose label association is weak; a word is swapped for others of its family. Both kinds weigh the same
in the loss, however many texts hold them.

The classifier is fitted on a bounded sample of labelled rows (`bound` per class); every document is scored on its
whole text, however long. Nulls and odd input: a null text counts as empty and gets the score of the bias alone. Labels
other than 0 and 1 are ignored; without labels of both classes the score is the share of label 1 seen (0 without
labels). Rows that repeat an id are scored one by one, equal texts get equal scores; of features with equal association
those first in code point order are kept, of words equally alike the more frequent. An empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.shared import fold, labelled_sample, log_odds, slices, strings
from skysieve.session import materialise

#: Words that name groups of people without judging them; each family is swapped within itself.
IDENTITY_FAMILIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("old", "young", "blind", "deaf", "disabled"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)
#: Lengths of word beginnings; swaps of a text.
BEGINNINGS, SWAPS = (4, 5, 6), 2
#: Features kept at most; texts and chi-square that a feature needs.
FEATURES, LEAST, ASSOCIATION = 4096, 3, 24.0
#: Frequent words considered; association below which a word is neutral; likeness of contexts; words of a family; contexts
#: that a word needs.
FREQUENT, WEAK, ALIKE, FAMILY, CONTEXTS = 400, 3.84, 0.7, 6, 30
#: Weight of the squared score change, of squared weights; steps and their size.
PAIRING, RIDGE, STEPS, RATE = 1.0, 2e-5, 400, 0.1


LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct runs of letters, so marks around or inside a word hide nothing."""
    return set(LETTERS.findall(text.lower()))


def features(words: set[str]) -> set[str]:
    """Words and their beginnings; `^` marks a beginning."""
    found = set(words)
    for n in BEGINNINGS:
        found.update(["^" + w[:n] for w in words if len(w) >= n])
    return found


def swapped(words: set[str], families=IDENTITY_FAMILIES, swaps: int = SWAPS, key: str = "") -> list[set[str]]:
    """The words with all identity terms swapped, `swaps` times; none without such terms."""
    named = {w: family for family in families for w in family if w in words}
    out = []
    for turn in range(swaps if named else 0):
        new = words - named.keys()
        for w, family in sorted(named.items()):
            others = [t for t in family if t != w]
            new.add(others[xxhash.xxh64_intdigest(f"{key}{w}{turn}", 7) % len(others)])
        out.append(new)
    return out


def _count_contexts(names: list[str]):
    """How often word i stands right after word j (context j) or right before it (context j + len(names)), per task."""
    index, m = {w: i for i, w in enumerate(names)}, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((m, 2 * m), np.int64)
        for batch in slices(batches):
            for text in strings(batch, "text"):
                at = np.array([index.get(w, -1) for w in LETTERS.findall(text.lower())], np.int64)
                first, second = at[:-1], at[1:]
                both = (first >= 0) & (second >= 0)
                np.add.at(seen, (first[both], second[both] + m), 1)
                np.add.at(seen, (second[both], first[both]), 1)
        word, context = np.nonzero(seen)
        yield pa.record_batch([pa.array(word), pa.array(context), pa.array(seen[word, context])], ["word", "context", "n"])

    return run


def alike(names: list[str], contexts: np.ndarray, neutral: list[bool]) -> list[tuple[str, ...]]:
    """Families of neutral words with like contexts; `names` are the most frequent first, `contexts` has a row of counts each."""
    x = np.sqrt(contexts)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    free = np.array(neutral, bool) & (contexts.sum(axis=1) >= CONTEXTS)
    families = []
    for i in range(len(names)):
        if free[i]:
            near = x @ x[i]
            near[i] = np.inf
            order = np.argsort(-near, kind="stable")
            family = [j for j in order if free[j] and near[j] >= ALIKE][:FAMILY]
            if len(family) > 1:
                free[family] = False
                families.append(tuple(names[j] for j in family))
    return families


def learned_families(sample: DataFrame, associations: DataFrame, fixed=IDENTITY_FAMILIES) -> list[tuple[str, ...]]:
    """Families of words of `sample` (text), from `associations` (feature, n: texts that hold it, chi)."""
    known = {w for family in fixed for w in family}
    frequent = associations.where(~F.col("feature").startswith("^")).orderBy(F.desc("n"), "feature").limit(FREQUENT).collect()
    if not frequent:
        return []
    names = [r["feature"] for r in frequent]
    counted = sample.select("text").mapInArrow(_count_contexts(names), "word long, context long, n long")
    contexts = np.zeros((len(names), 2 * len(names)))
    for r in counted.groupBy("word", "context").agg(F.sum("n").alias("n")).collect():  # at most 2 * FREQUENT ** 2
        contexts[r["word"], r["context"]] = r["n"]
    return alike(names, contexts, [r["chi"] < WEAK and r["feature"] not in known for r in frequent])


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        by_label = (Counter(), Counter())
        for text, y in zip(strings(batch, "text"), batch.column("y").to_pylist()):
            by_label[y].update(features(words_of(text)))
        names = list(by_label[0].keys() | by_label[1].keys())
        counts = [pa.array([c[f] for f in names], pa.int64()) for c in by_label]
        yield pa.record_batch([pa.array(names, pa.string()), *counts], ["feature", "n0", "n1"])


def _encode(index: dict[str, int], families, learned):
    """Rows of feature numbers: of a text, of its swaps by fixed families, of its swap by learned ones."""
    theirs = {w for family in (*families, *learned) for w in family}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda ws: sorted(index[f] for f in features(ws) if f in index)
        for batch in slices(batches):
            rows, fixed, free = [], [], []
            for text in strings(batch, "text"):
                # other words have no feature, before or after a swap
                words = {w for w in words_of(text) if w in theirs or not index.keys().isdisjoint(features({w}))}
                key = xxhash.xxh64_hexdigest(text.encode())
                rows.append(pick(words))
                fixed.append([pick(w) for w in swapped(words, families, key=key)])
                free.append([pick(w) for w in swapped(words, learned, 1, key)])
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.record_batch(
                [batch.column("y"), pa.array(rows, pa.list_(pa.int32())), pa.array(fixed, kind), pa.array(free, kind)],
                ["y", "x", "fixed", "free"],
            )

    return run


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.fromiter((i for r in rows for i in r), np.int64, len(self.row))
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, err: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, err[self.row], self.width)


def fit_weights(
    rows, labels, pairs, swaps, width: int, bias: float, pairing: float = PAIRING, shares=None,
) -> tuple[np.ndarray, float]:
    """Weights and bias; `pairs[i]` is the row that `swaps[i]` was made from, `shares[i]` its weight (the same for all)."""
    x, z, y, pairs = _Rows(rows, width), _Rows(swaps, width), np.asarray(labels, float), np.asarray(pairs, int)
    shares = np.full(z.n, 1 / max(1, z.n)) if shares is None else np.asarray(shares, float)
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    w[-1] = bias
    for step in range(1, STEPS + 1):
        scores = x.times(w[:-1]) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - y) / max(1, x.n)
        grad = np.append(x.back(err) + RIDGE * w[:-1], err.sum())
        if z.n:
            change = (z.times(w[:-1]) + w[-1] - scores[pairs]) * (2 * pairing * shares)
            grad[:-1] += z.back(change) - x.back(np.bincount(pairs, change, x.n))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, families=IDENTITY_FAMILIES,
    pairing: float = PAIRING,
) -> Model:
    sample, counts = labelled_sample(documents, labels, label, folds, held, bound, "toxicity-sample")
    if len(counts) < 2:
        ones, n = counts.get(1, 0), sum(counts.values())
        return Model({}, 30.0 if n and ones == n else -30.0)
    taken = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    seen = sample.select("text", "y").mapInArrow(_count_features, "feature string, n0 long, n1 long")
    totals = seen.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST)
    size0, size1 = (max(1, taken.get(y, 0)) for y in (0, 1))
    # chi-square of the feature with the label
    a, b = F.col("n1") / size1, F.col("n0") / size0
    share = (F.col("n0") + F.col("n1")) / (size0 + size1)
    chi = (a - b) * (a - b) / (share * (1.0001 - share)) * (size0 * size1 / (size0 + size1))
    totals = materialise(totals.select("feature", (F.col("n0") + F.col("n1")).alias("n"), chi.alias("chi")), "toxicity-features")
    best = totals.where(F.col("chi") >= ASSOCIATION).orderBy(F.desc("chi"), "feature").limit(FEATURES)
    index = {r["feature"]: i for i, r in enumerate(best.collect())}
    learned = learned_families(sample, totals, families)
    for w in (w for family in (*families, *learned) for w in family):  # swaps must be able to cost something
        index.setdefault(w, len(index))
    kinds = "y int, x array<int>, fixed array<array<int>>, free array<array<int>>"
    coded = sample.select("text", "y").mapInArrow(_encode(index, families, learned), kinds).toArrow()
    # rows in an order of their own, so that reruns add up alike
    rows = sorted(zip(*(coded.column(c).to_pylist() for c in ("x", "y", "fixed", "free"))))
    pairs, swaps, shares = [], [], []
    for kind in (2, 3):
        found = [r[kind] for r in rows]
        mine = [i for i, s in enumerate(found) for _ in s]
        pairs += mine
        swaps += [r for s in found for r in s]
        shares += [1 / max(1, len(mine))] * len(mine)
    x, y = [r[0] for r in rows], [r[1] for r in rows]
    weights, bias = fit_weights(x, y, pairs, swaps, len(index), log_odds(taken), pairing, shares)
    # the classes were sampled at different rates
    bias += log_odds(counts) - log_odds(taken)
    return Model({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {f: w for f, w in model.weights.items() if f[0] != "^"}
        starts = [{f[1:]: w for f, w in model.weights.items() if f[0] == "^" and len(f) == n + 1} for n in BEGINNINGS]
        for batch in slices(batches):
            scores = []
            for text in strings(batch, "text"):
                words = words_of(text)
                total = model.bias + math.fsum(whole[w] for w in words & whole.keys())
                for n, known in zip(BEGINNINGS, starts):
                    total += math.fsum(known[s] for s in {w[:n] for w in words} & known.keys())
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1,
    bound: int = 12_000, cut: float = 0.7, doc_id: str = "doc_id", text: str = "text", families=IDENTITY_FAMILIES,
    pairing: float = PAIRING,
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(docs, labels, label, folds, held, bound, families, pairing)
    rows = docs.withColumn("held_out", fold("doc_id", folds) == held)
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
