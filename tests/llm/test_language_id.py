from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from skysieve.llm.language_id import MARK, Pieces, _mix, by_length, expected_counts, forward, load_pieces, predict_language
from skysieve.llm.shared import sample_per_class

PATH = public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(strings):
    """A small vocabulary, and the number of each of its pieces."""
    hashes = {}
    for s in strings:
        h = np.zeros(1, np.uint64)
        for c in s:
            h = _mix(h, np.array([ord(c)]))
        hashes[s] = int(h[0])
    order = np.unique(np.array(list(hashes.values()), np.uint64))
    numbers = {s: int(np.searchsorted(order, np.uint64(h))) for s, h in hashes.items()}
    return Pieces(order, max(map(len, strings))), numbers


def segmentations(word, numbers, unknown):
    """All ways to cut a word, as lists of piece numbers."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        number = numbers.get(word[:n], unknown if n == 1 else None)
        if number is not None:
            out += [[number, *rest] for rest in segmentations(word[n:], numbers, unknown)]
    return out


VOCABULARY = [MARK, "a", "b", "ab", "ba", MARK + "a", MARK + "ab", "abab", "bb", "é"]
WORDS = ["", "a", "ab", "abab", "babab", "bbaé", "xab", "ab" * 6, "é日", "abx"]


def test_forward_and_expected_counts_match_all_segmentations():
    pieces, numbers = pieces_of(VOCABULARY)
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces.hashes) + 1, 2))
    prob /= prob.sum(axis=0)
    counts = np.arange(1, len(WORDS) + 1, dtype=float)
    got, expected = np.zeros((len(WORDS), 2)), np.zeros(len(prob))
    for places, codes in by_length(WORDS):
        got[places] = forward(codes, pieces, prob)
        expected += expected_counts(codes, counts[places], pieces, prob[:, 0])
    want = np.zeros(len(prob))
    for i, word in enumerate(WORDS):
        cuts = segmentations(MARK + word, numbers, len(pieces.hashes))
        for lang in range(2):
            assert got[i, lang] == pytest.approx(math.log(sum(math.prod(prob[c, lang] for c in cut) for cut in cuts)))
        weights = [math.prod(prob[c, 0] for c in cut) for cut in cuts]
        for cut, weight in zip(cuts, weights):
            for c in cut:
                want[c] += counts[i] * weight / sum(weights)
    assert expected == pytest.approx(want)


def test_long_words_stay_in_range():
    pieces = load_pieces(PATH)
    prob = np.full((len(pieces.hashes) + 1, 3), 1e-5)
    for _, codes in by_length(["abc" * 700, "日" * 500]):
        assert np.isfinite(forward(codes, pieces, prob)).all()


def log_counts(word, numbers, unknown, longest, logs):
    """Expected pieces of one word by sums of logarithms, place by place."""
    cuts = [
        (a, b, numbers.get(word[a:b], unknown))
        for a in range(len(word)) for b in range(a + 1, min(len(word), a + longest) + 1)
        if b == a + 1 or word[a:b] in numbers
    ]
    alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
    alpha[0] = beta[-1] = 0
    for a, b, c in sorted(cuts, key=lambda cut: cut[1]):
        alpha[b] = np.logaddexp(alpha[b], alpha[a] + logs[c])
    for a, b, c in sorted(cuts, key=lambda cut: -cut[0]):
        beta[a] = np.logaddexp(beta[a], beta[b] + logs[c])
    want = np.zeros(len(logs))
    for a, b, c in cuts:
        want[c] += math.exp(alpha[a] + logs[c] + beta[b] - alpha[-1])
    return want


@pytest.mark.parametrize("word", ["a" * 700, "-" * 400, "".join(chr(0x4E00 + i) for i in range(500))])
@pytest.mark.parametrize("seed", [None, 0])
def test_expected_counts_of_long_words_match_log_space(word, seed):
    strings = [MARK, MARK + "a", *["a" * n for n in range(1, 17)], *["-" * n for n in range(1, 17)], *[chr(0x4E00 + i) for i in range(490)]]
    pieces, numbers = pieces_of(strings)
    # the first round's uniform values over the whole vocabulary, and very uneven ones
    prob = np.full(len(pieces.hashes) + 1, 1 / 28_000)
    if seed is not None:
        prob = np.exp(np.random.default_rng(seed).uniform(-20, -3, len(prob)))
    ((places, codes),) = by_length([word])
    got = expected_counts(codes, np.array([3.0]), pieces, prob)
    assert np.isfinite(got).all()
    assert got == pytest.approx(3 * log_counts(MARK + word, numbers, len(pieces.hashes), pieces.longest, np.log(prob)), rel=1e-6, abs=1e-9)


SYLLABLES = {"aa": ["the", "ing", "and"], "bb": ["sch", "keit", "ü"], "cc": ["ción", "que", "ñ"]}


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words), lang, "s", 1))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, docs_of):
    rows = corpus()
    odd = [(900, None, "aa", "s", 1), (901, "", "aa", "s", 1), (902, " 123 !?", "bb", "s", 1), (903, "schkeit", None, "s", 1),
           (None, "ción", "cc", "s", 1), (3, "the and", "aa", "s", 1), (904, "ingand" * 3000, None, "s", 1), (905, "日本", None, None, None)]
    docs = docs_of(rows + odd).selectExpr("*", "1 as score", "2 as word", "3 as letters")
    got = predict_language(docs, PATH).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    out = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out and r.doc_id in truth]
    assert sum(out) >= 0.97 * len(out) > 50
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and by_id[905].lang_pred in SYLLABLES
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_no_training_rows_and_empty_table(spark, docs_of):
    assert {r.lang_pred for r in predict_language(docs_of([(1, "abc", None, "s", 1)]), PATH).collect()} == {"und"}
    assert predict_language(docs_of([]), PATH).collect() == []


def test_vocabulary_is_read_whole():
    pieces = load_pieces(PATH)
    assert len(pieces.hashes) > 20_000 and pieces.longest < 64
    assert Counter(np.diff(pieces.hashes.astype(float)) > 0)[False] == 0


def test_sample_is_bounded_per_language(spark, docs_of):
    rare = [(10_000 + i, "ciónque ñque " * 5, "cc", "s", 1) for i in range(4)]
    rows = [(i, f"theing and{i % 7}", "aa", "s", 1) for i in range(3000)] + rare
    got = {r.doc_id: r.lang_pred for r in predict_language(docs_of(rows), PATH, bound=20).collect()}
    assert {got[i] for i, *_ in rare} == {"cc"} and got[0] == "aa"


def test_sample_follows_rows_and_small_shares(spark, docs_of):
    # one id in all rows, and a null one: rows are drawn one by one
    rows = [(7 if i % 2 else None, f"the {i}", "aa" if i % 4 < 2 else "bb", "s", 1) for i in range(4000)]
    counts = {"aa": 2000, "bb": 2000}
    drawn = sample_per_class(docs_of(rows), "lang", counts, 400, 3)
    assert all(300 < n < 500 for n in Counter(r.lang for r in drawn.collect()).values())
    # a class within the bound is whole, whatever the share of the other
    few = sample_per_class(docs_of(rows), "lang", {"aa": 2000, "bb": 4_000_000_000}, 40_000_000, 3).collect()
    assert Counter(r.lang for r in few)["aa"] == 2000 and 0 < Counter(r.lang for r in few)["bb"] < 60
