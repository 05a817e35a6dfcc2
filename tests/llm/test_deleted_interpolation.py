from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skysieve.llm.deleted_interpolation import FREQUENCIES, ROUNDS, LEAST_GAIN, WORDS, _add_up, interpolated_scores, keys_of, planes, unplanes


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def counted(texts):
    words, pairs = Counter(), Counter()
    for tokens in texts:
        words.update(tokens)
        pairs.update(zip([None, *tokens], tokens))
    return words, pairs, sum(words.values()), len(words)


def bucket(c):
    return min(c.bit_length(), FREQUENCIES - 1)


def brute(rows):
    """The same model with plain dictionaries."""
    part = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 10 for i, (d, _) in enumerate(rows)}
    tokens = {i: tokens_of(t) for i, (_, t) in enumerate(rows)}
    words, pairs, total, types = counted([tokens[i] for i in part if part[i] >= 1])
    kept_words, kept_pairs, kept_total, kept_types = counted([tokens[i] for i in part if part[i] >= 2])
    held = []
    for i in part:
        if part[i] == 1:
            for h, w in zip([None, *tokens[i]], tokens[i]):
                c = kept_words[h]
                held.append((bucket(c), kept_pairs[h, w] / max(1, c), kept_words[w] / max(1, kept_total)))
    weights, last = np.full((FREQUENCIES, 3), 1 / 3), -math.inf
    for _ in range(ROUNDS):
        use, loss = np.zeros((FREQUENCIES, 3)), 0.0
        for b, high, low in held:
            parts = weights[b] * [high, low, 1 / (kept_types + 1)]
            use[b] += parts / parts.sum()
            loss += math.log(parts.sum())
        n = use.sum(axis=1, keepdims=True)
        weights = np.where(n > 0, use / np.maximum(n, 1e-300), weights)
        weights = np.maximum(weights, 1e-9)
        weights /= weights.sum(axis=1, keepdims=True)
        if not held or (loss - last) / len(held) < LEAST_GAIN:
            break
        last = loss
    out = []
    for i, (d, _) in enumerate(rows):
        base = score = 0.0
        for h, w in zip([None, *tokens[i]], tokens[i]):
            base += math.log10((words[w] + 0.1) / (total + 0.1 * (types + 1)))
            mix = weights[bucket(words[h])].copy()
            if not words[h]:
                mix[0] = 0
                mix /= mix.sum()
            score += math.log10(mix @ [pairs[h, w] / max(1, words[h]), words[w] / max(1, total), 1 / (types + 1)])
        known = sum(words[w] > 0 for w in tokens[i])
        out.append((d, part[i] == 0, len(tokens[i]), known, total, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "THE", "the", "x\x1fy"]
    rows = []
    for i in range(n):
        words, w = [], rng.choice(vocabulary)
        for _ in range(rng.randint(0, 40)):
            w = vocabulary[(vocabulary.index(w) * 7 + rng.randint(0, 3)) % 64] if rng.random() < 0.7 else rng.choice(vocabulary)
            words.append(w)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(5, None), (None, "the the"), (900, ""), (901, " \t"), (902, "the " * 5000), (902, "the " * 5000)]


def test_matches_brute_force(spark, docs_of):
    rows = corpus(300)
    close(interpolated_scores(docs_of(rows), batch_tokens=700, bucket_keys=300).collect(), brute(rows))


def test_unknown_words(spark, docs_of):
    free = next(i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = corpus(200, 3) + [(free, "never seen w1")]
    got = interpolated_scores(docs_of(rows)).collect()
    close(got, brute(rows))
    assert [(r.n_tokens, r.n_known, r.held_out) for r in got if r.doc_id == free] == [(4, 2, True)]


def test_held_out_text_is_likelier_than_under_the_base(spark, docs_of):
    found = [r for r in interpolated_scores(docs_of(corpus(600, 5))).collect() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_no_training_documents_and_empty_table(spark, docs_of):
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(free, "a b"), (free, None)]
    close(interpolated_scores(docs_of(rows)).collect(), brute(rows))
    assert interpolated_scores(docs_of([])).collect() == []


def test_extra_columns_with_clashing_names(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "b")]).selectExpr("*", "'x' as part", "1 as batch", "2 as kind", "3 as score")
    assert len(interpolated_scores(docs).collect()) == 2


def test_planes_round_trip():
    values = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (unplanes(planes(values), np.uint64) == values).all()
    assert len(unplanes(planes(values[:0]), np.uint64)) == 0


def test_counts_beyond_32_bits_are_exact():
    key, n = np.array([5], np.uint64), np.array([3_000_000_000], np.uint32)
    row = {"kind": WORDS, "batch": "all-0", "bucket": 0, "keys": planes(key), "train": planes(n), "kept": planes(n)}
    found = _add_up(pa.Table.from_pylist([row, row | {"batch": "all-1"}, row | {"batch": "held-2"}])).to_pylist()
    assert [unplanes(r["train"], np.uint64).tolist() for r in found[1:]] == [[9_000_000_000]] * 3
    assert unplanes(found[3]["kept"], np.uint64).tolist() == [9_000_000_000] and found[0]["total"] == 9_000_000_000


def test_words_are_told_apart_by_all_bits():
    h = np.array([1 << 60, (1 << 60) + 1], np.uint64)
    assert len(set(zip(*(x.tolist() for x in keys_of(WORDS, h, 8))))) == 2
