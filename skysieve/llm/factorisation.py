"""Quality classifier: a factorisation machine.

A document is a sparse row of hashed words (each with the same small value), structure statistics of its text and
metadata. The score adds to the linear part the interactions of all pairs of features, each pair weighted by the
product of two low-rank factors; the sum over pairs is half the squared sum minus the sum of squares per factor, so
scoring is linear in the number of features.

The model is fitted on a bounded sample of labelled rows (`bound` per class); every document is scored on its whole
text. Nulls and odd input: a null text counts as empty, null metadata as missing (the mean). Labels other than 0 and
1 are ignored; with labels of one class, or none, the score is a constant (that class, or 0.5). Rows that repeat an
id are scored one by one, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.shared import fold, labelled_sample, log_odds, slices, utf8

#: Hashed words; factors; passes, rows of a step, step size, weight of squared parameters; words whose hash is kept.
BUCKETS, FACTORS, PASSES, STEP_ROWS, RATE, RIDGE, KEPT = 1 << 16, 8, 8, 128, 0.1, 1e-3, 200_000
#: Statistics are cut at so many deviations from the mean.
LIMIT = 4.0
STATISTICS = (
    "bytes", "words", "word_length", "upper", "digits", "stops", "symbols", "bars", "shouts", "spaces", "beyond_ascii",
    "distinct_words", "repeated_words", "most_frequent", "distinct_lines", "words_per_line", "short_lines", "metadata",
)
SYMBOLS = [b for b in b"#$%&*+/<=>@[]^_`{}~\\"]


def statistics(text: bytes, words: list[bytes], counts: Counter, metadata: int | None) -> list[float]:
    """Structure of a text, shares and logarithms; the last is metadata, NaN if missing."""
    signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, n = max(1, len(text)), max(1, len(words))
    upper, lower = int(signs[65:91].sum()), int(signs[97:123].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n,
        upper / max(1, upper + lower), int(signs[48:58].sum()) / size, (int(signs[46]) + int(signs[44])) / n,
        int(signs[SYMBOLS].sum()) / size, int(signs[124]) / n, int(signs[33]) / n,
        int(signs[9:14].sum() + signs[32]) / size, int(signs[128:].sum()) / size,
        len(counts) / n, sum(map(operator.eq, words, words[1:])) / n, max(counts.values(), default=0) / n,
        len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        sum(len(line) < 40 for line in lines) / max(1, len(lines)),
        math.nan if metadata is None else math.log1p(max(0, metadata)),
    ]


class WordHashes:
    """Hashes of words, kept for the next text."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, words) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w) % self.buckets
            out.append(h)
        return out


def _describe(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[list[list[int]], np.ndarray]:
    rows, stats = [], []
    for text, metadata in zip(utf8(batch, "text"), batch.column("metadata").to_pylist()):
        words = text.lower().split()
        counts = Counter(words)
        rows.append(hashes.of(counts))
        stats.append(statistics(text, words, counts, metadata))
    return rows, np.array(stats).reshape(-1, len(STATISTICS))


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # of words, then of statistics
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def standardised(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num((stats - mean) / spread), -LIMIT, LIMIT)


def assemble(rows: list[list[int]], stats: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (first entry of each row, feature, value): statistics first, then words."""
    k = stats.shape[1]
    sizes = np.array([len(r) for r in rows]) + k
    starts = np.cumsum(sizes) - sizes
    at = np.empty(int(sizes.sum()), np.int64)
    value = np.empty(len(at))
    for start, size, row, s in zip(starts, sizes, rows, stats):
        at[start : start + k], value[start : start + k] = np.arange(buckets, buckets + k), s
        at[start + k : start + size], value[start + k : start + size] = row, 1 / math.sqrt(max(1, len(row)))
    return starts, at, value


def scores(model: Model, starts: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """w0 + w.x + the interactions of all pairs, in linear time."""
    if not len(starts):
        return np.zeros(0)
    parts = model.factors[at] * value[:, None]
    sums = np.add.reduceat(parts, starts)
    squares = np.add.reduceat(parts * parts, starts)
    return model.bias + np.add.reduceat(model.weights[at] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[list[int]], stats: np.ndarray, labels: np.ndarray, buckets: int, seed: int = 7) -> Model:
    """Adaptive gradient steps on the log loss, in an order fixed by the seed."""
    rng = np.random.default_rng(seed)
    known = ~np.isnan(stats)
    n = np.maximum(1, known.sum(axis=0))
    mean = np.where(known, stats, 0).sum(axis=0) / n
    spread = np.sqrt((np.where(known, stats - mean, 0) ** 2).sum(axis=0) / n) + 1e-6
    stats = standardised(stats, mean, spread)
    width = buckets + stats.shape[1]
    model = Model(0.0, np.zeros(width), rng.normal(0, 0.01, (width, FACTORS)), mean, spread)
    bias = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, FACTORS), 1e-6), 1e-6
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), STEP_ROWS):
            mine = order[a : a + STEP_ROWS]
            starts, at, value = assemble([rows[i] for i in mine], stats[mine], buckets)
            model = model._replace(bias=bias)
            err = (logistic(scores(model, starts, at, value)) - labels[mine]) / len(mine)
            sizes = np.diff(np.append(starts, len(at)))
            each = np.repeat(err, sizes)
            parts = model.factors[at] * value[:, None]
            sums = np.add.reduceat(parts, starts)
            grad_v = (each * value)[:, None] * (np.repeat(sums, sizes, axis=0) - parts)
            used, place = np.unique(at, return_inverse=True)
            g = np.bincount(place, each * value, len(used)) + RIDGE * model.weights[used] / len(mine)
            seen_w[used] += g * g
            model.weights[used] -= RATE * g / np.sqrt(seen_w[used])
            for f in range(FACTORS):
                g = np.bincount(place, grad_v[:, f], len(used)) + RIDGE * model.factors[used, f] / len(mine)
                seen_v[used, f] += g * g
                model.factors[used, f] -= 0.3 * RATE * g / np.sqrt(seen_v[used, f])
            seen_b += err.sum() ** 2
            bias -= RATE * err.sum() / math.sqrt(seen_b)
    return model._replace(bias=bias)


def _code(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(buckets)
        for batch in slices(batches):
            rows, stats = _describe(batch, hashes)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()))
            columns = [pa.array(c, k) for c, k in zip((rows, list(stats)), kinds)]
            yield pa.record_batch([batch.column("y"), *columns], ["y", "words", "stats"])

    return run


def _found(inputs: list[pa.Array], model: Model | None, constant: float, hashes: WordHashes) -> np.ndarray:
    """Scores of (text, metadata) columns."""
    if model is None:
        return np.full(len(inputs[0]), constant)
    rows, stats = _describe(pa.record_batch(inputs, ["text", "metadata"]), hashes)
    return logistic(scores(model, *assemble(rows, standardised(stats, model.mean, model.spread), hashes.buckets)))


def _score(model: Model | None, constant: float, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(buckets)
        for batch in slices(batches):
            found = _found([batch.column(c) for c in ("text", "metadata")], model, constant, hashes)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, buckets: int) -> tuple[Model | None, float]:
    """A model of rows (doc_id, text, metadata), or none and the constant score."""
    sample, counts = labelled_sample(docs, labels, label, folds, held, bound, "quality-sample")
    if len(counts) < 2:
        return None, float(next(iter(counts), 0.5))
    coded = sample.select("text", "metadata", "y").mapInArrow(_code(buckets), "y int, words array<int>, stats array<double>")
    coded = coded.toArrow()  # bounded by the sample
    words = [np.asarray(w.as_py(), np.int64) for w in coded.column("words")]
    # steps go through the rows in an order of their content, not of the tasks that read them
    order = sorted(range(len(words)), key=lambda i: (zlib.crc32(words[i].tobytes()), len(words[i])))
    words, y = [words[i] for i in order], coded.column("y").to_numpy().astype(float)[order]
    stats = np.array(coded.column("stats").to_pylist()).reshape(-1, len(STATISTICS))[order]
    model = train(words, stats, y, buckets)
    # the classes were sampled at different rates
    taken = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    return model._replace(bias=model.bias + log_odds(counts) - log_odds(taken)), 0.5


def _inputs(documents: DataFrame, doc_id: str, text: str, metadata: str | None) -> list:
    extra = F.col(metadata).cast("long") if metadata else F.lit(None).cast("long")
    return [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), extra.alias("metadata")]


def quality_scores(
    documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
    bound: int = 8_000, cut: float = 0.5, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text", metadata: str | None = "n_chars",
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. `metadata` is a column of sizes, or None."""
    docs = documents.select(*_inputs(documents, doc_id, text, metadata))
    model, constant = fit(docs, labels, label, folds, held, bound, buckets)
    rows = docs.withColumn("held_out", fold("doc_id", folds) == held)
    scored = rows.mapInArrow(_score(model, constant, buckets), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(
    documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
    bound: int = 8_000, cut: float = 0.5, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text", metadata: str | None = "n_chars",
) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    inputs = _inputs(documents, doc_id, text, metadata)
    model, constant = fit(documents.select(*inputs), labels, label, folds, held, bound, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(buckets)
        for batch in slices(batches):
            good = pa.array(_found(batch.column("__in").flatten(), model, constant, hashes) >= cut)
            yield batch.drop_columns(["__in"]).filter(good)

    return documents.withColumn("__in", F.struct(*inputs[1:])).mapInArrow(run, documents.schema)
