"""Language ID with segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces of the product of their probabilities, by a forward pass; a text is the
product of its words. Piece probabilities are learned by expectation-maximisation over word counts: expected piece
counts come from forward and backward passes in tasks and are summed by Spark. Passes run over all words of one
length at once, and each distinct word of a slice of texts is scored once.

Piece probabilities are fitted on a bounded sample of texts (about `bound` rows of each language, by the hash of id
and text), so every language with a training row is learned; priors come from the counts of all training rows. Every
document is predicted from its whole text. Nulls and odd input: a null text, or one without a letter, is `und` with score 0;
rows without a language teach nothing. Characters outside the vocabulary are pieces of their own with a smoothed
probability, so every text has a segmentation. Without training rows all texts are `und`. Ties go to the language
that sorts first. Rows that repeat an id are predicted one by one, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.shared import fold, sample_per_class, slices, strings
from skysieve.session import materialise

#: Start of a word in the vocabulary; rounds of EM; pseudo-count of a piece; words scored at once; words kept.
MARK, ROUNDS, SMOOTH, WORDS_AT_ONCE, KEPT = "▁", 4, 0.01, 20_000, 200_000
#: Numbers that a pass holds at once.
CELLS = 2_000_000
#: Probabilities are rescaled after so many characters.
RESCALE = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    """A vocabulary as sorted hashes of its pieces; number `len(hashes)` stands for any unknown character."""

    hashes: np.ndarray
    longest: int


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ (codes.astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model, lower-cased, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {
        model.id_to_piece(i).lower()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    by_length = defaultdict(list)
    for piece in kept:
        by_length[len(piece)].append(piece)
    hashes = []
    for n, pieces in by_length.items():
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").reshape(-1, n)
        h = np.zeros(len(pieces), np.uint64)
        for i in range(n):
            h = _mix(h, codes[:, i])
        hashes.append(h)
    return Pieces(np.unique(np.concatenate(hashes)), max(by_length))


def spans(codes: np.ndarray, pieces: Pieces) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(start, end) -> (words that have a piece there, its number), for words of equal length (rows of codes)."""
    words, n = codes.shape
    unknown, found = len(pieces.hashes), {}
    for start in range(n):
        h = np.zeros(words, np.uint64)
        for end in range(start + 1, min(n, start + pieces.longest) + 1):
            h = _mix(h, codes[:, end - 1])
            at = np.searchsorted(pieces.hashes, h)
            at[at == unknown] = 0
            hit = pieces.hashes[at] == h
            if end == start + 1:
                found[start, end] = np.arange(words), np.where(hit, at, unknown)
            elif hit.any():
                rows = np.flatnonzero(hit)
                found[start, end] = rows, at[rows]
    return found


def forward(codes: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Natural log probability of each word (row) under each language (column of `prob`)."""
    words, n = codes.shape
    found = spans(codes, pieces)
    alpha = np.zeros((n + 1, words, prob.shape[1]))
    alpha[0] = 1
    logs = np.zeros((words, prob.shape[1]))
    for end in range(1, n + 1):
        for start in range(max(0, end - pieces.longest), end):
            if (start, end) in found:
                rows, number = found[start, end]
                if len(rows) == words:
                    alpha[end] += alpha[start] * prob[number]
                else:
                    alpha[end, rows] += alpha[start, rows] * prob[number]
        if end % RESCALE == 0:
            low = max(0, end - pieces.longest)
            top = alpha[low : end + 1].max(axis=0)
            alpha[low : end + 1] /= top
            logs += np.log(top)
    return logs + np.log(alpha[n])


def expected_counts(codes: np.ndarray, counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece in words (rows) with counts, under one language's probabilities.

    Sums are kept as logarithms per position, so that words of any length stay in range.
    """
    words, n = codes.shape
    found = spans(codes, pieces)
    logs = np.log(prob)
    alpha, beta = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    for end in range(1, n + 1):
        low = max(0, end - pieces.longest)
        top = alpha[low:end].max(axis=0)
        ahead, total = np.exp(alpha[low:end] - top), np.zeros(words)
        for start in range(low, end):
            if (start, end) in found:
                rows, number = found[start, end]
                total[rows] += ahead[start - low, rows] * prob[number]
        alpha[end] = top + np.log(total)
    for start in range(n - 1, -1, -1):
        high = min(n, start + pieces.longest)
        top = beta[start + 1 : high + 1].max(axis=0)
        behind, total = np.exp(beta[start + 1 : high + 1] - top), np.zeros(words)
        for end in range(start + 1, high + 1):
            if (start, end) in found:
                rows, number = found[start, end]
                total[rows] += behind[end - start - 1, rows] * prob[number]
        beta[start] = top + np.log(total)
    out = np.zeros(len(pieces.hashes) + 1)
    for (a, b), (rows, number) in found.items():
        share = np.exp(alpha[a, rows] + logs[number] + beta[b, rows] - alpha[n, rows])
        out += np.bincount(number, share * counts[rows], len(out))
    return out


def by_length(words: list[str], columns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, codes) of words of equal length, the mark in front, in bounded groups."""
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for n, places in groups.items():
        room = max(1, min(WORDS_AT_ONCE, CELLS // ((n + 1) * columns)))
        for a in range(0, len(places), room):
            mine = places[a : a + room]
            text = "".join([MARK + words[i] for i in mine])
            yield np.array(mine), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts = defaultdict(Counter)
        for text, lang in zip(strings(batch, "text"), batch.column("lang").to_pylist()):
            counts[lang].update(text.lower().split())
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _expect(pieces: Pieces, langs: list[str], prob: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(pieces.hashes) + 1))
        for batch in batches:
            mine = defaultdict(lambda: ([], []))
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                mine[lang][0].append(word)
                mine[lang][1].append(n)
            for lang, (words, counts) in mine.items():
                at, counts = langs.index(lang), np.array(counts, float)
                for places, codes in by_length(words):
                    total[at] += expected_counts(codes, counts[places], pieces, prob[:, at])
        at, number = np.nonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(number, pa.int32()), pa.array(total[at, number])], ["at", "number", "n"])

    return run


def learn(
    rows: DataFrame, shares: dict[str, int], pieces: Pieces, rounds: int = ROUNDS
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (a column each) and log priors from rows of (lang, text); `shares`: rows of each."""
    langs = sorted(shares)
    words = rows.mapInArrow(_count_words, "lang string, word string, n long")
    words = materialise(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    width = len(pieces.hashes) + 1
    prob = np.full((width, len(langs)), 1 / width)
    for _ in range(rounds):
        sums = words.mapInArrow(_expect(pieces, langs, prob), "at int, number int, n double")
        found = sums.groupBy("at", "number").agg(F.sum("n").alias("n")).toArrow()  # languages x pieces at most
        counts = np.full((width, len(langs)), SMOOTH)
        np.add.at(counts, (found.column("number").to_numpy(), found.column("at").to_numpy()), found.column("n").to_numpy())
        prob = counts / counts.sum(axis=0)
    prior = np.log(np.array([shares[lang] for lang in langs], float) / max(1, sum(shares.values())))
    return langs, prob, prior


def _predict(pieces: Pieces, langs: list[str], prob: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in slices(batches):
            if len(place) > KEPT:
                place.clear()
                table = table[:0]
            texts = [t.lower().split() for t in strings(batch, "text")]
            numbers = [[place.setdefault(w, len(place)) for w in words] for words in texts]
            new = list(place)[len(table) :]
            more = np.zeros((len(new), len(langs)))
            for places, codes in by_length(new, len(langs)):
                more[places] = forward(codes, pieces, prob)
            table = np.concatenate([table, more])
            totals = np.array([prior + table[n].sum(axis=0) for n in numbers]).reshape(-1, len(langs))
            best = totals.argmax(axis=1)
            certain = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([langs[b] if ok else "und" for b, ok in zip(best, letters)], pa.string()),
                    pa.array(np.where(letters, certain, 0.0)),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict_language(
    documents: DataFrame, vocabulary: str, folds: int = 3, held: int = 1, bound: int = 6_000,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the posterior of the prediction). `vocabulary`: a model's path.

    `bound`: rows per language that teach, about.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    taught = docs.where((fold("doc_id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}
    sample = sample_per_class(taught, "lang", shares, bound, 3)
    sample = materialise(sample.select("lang", "text"), "language-sample")
    pieces = load_pieces(vocabulary)
    langs, prob, prior = learn(sample, shares, pieces)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "text", letters.alias("letters"))
    if not langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(_predict(pieces, langs, prob, prior), schema)
