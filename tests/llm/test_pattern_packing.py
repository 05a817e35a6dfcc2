from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skysieve.llm.pattern_packing import best_fit, exact_patterns, pack_documents, plan_packing
from skysieve.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_those_of_the_whole_text():
    whole, words, rng = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(0)
    signs = "aAbZ'sé ÉİΣςßẞ<|endoftext|>.,!?0123½²ªº\u0301  \x1c\x85日本語ａ\t\n…—%&$#*|ǅǆ'll'tΆ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["", "Hello, world!!", "<|endoftext|>.", "naïve Œuvre.", "it's they'll we'd", "ﬁ½.", "a" * 3000]
    for text in texts:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.ids(text.encode()) == want, text


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr("skysieve.llm.tokens.KEPT", 20)
    words, whole = WordIds(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"word{i} longerword{i}." for i in range(200))
    assert len(words.ids(text.encode())) == 4 * len(whole.encode(text, add_special_tokens=False).ids)
    assert len(words.known) <= 420


def check_plan(histogram, capacity, plan):
    used, rooms = defaultdict(list), defaultdict(list)
    for length, rank, count, each, sequence, offset in plan:
        used[length].append((rank, count))
        for i in range(count):
            rooms[sequence + i // each].append((offset + i % each * length, length))
    for length, n in enumerate(histogram):
        at = 0
        for rank, count in sorted(used[length]):
            assert rank == at
            at += count
        assert at == (n if length else 0)
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_everything_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 2, 7, 64, 256]))
    histogram = rng.integers(0, [1, 3, 50][seed % 3] + 1, capacity + 1) * (rng.random(capacity + 1) < rng.choice([0.1, 0.6, 1]))
    n = check_plan(histogram, capacity, plan_packing(histogram, capacity, grid=4, steps=80))
    total = int((histogram * np.arange(capacity + 1)).sum())
    plain = sum(m for _, m in best_fit(np.where(np.arange(capacity + 1) > 0, histogram, 0), capacity))
    assert -(-total // capacity) <= n <= max(plain + 2, plain * 1.02)


def test_full_size_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 30_000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=2049)
    n = check_plan(histogram, 2048, plan_packing(histogram, 2048))
    assert n <= 1.002 * lengths.sum() / 2048 + 2


def test_patterns_fill_exactly():
    rows = exact_patterns(64, 4)
    assert (rows.sum(axis=1) == 64).all() and (np.diff(rows, axis=1) <= 0).all()


def test_pieces_of_documents(spark, docs_of):
    rng, whole = random.Random(2), Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rng.choice(["the", "Cat,", "x", "évé", "12!"]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "a b"), (907, "again"), (907, "again"), (502, "word " * 500)] + [(600 + i, "same text") for i in range(300)]
    docs = docs_of(rows).selectExpr("*", "1 as length", "2 as salt", "3 as rank")
    got = pack_documents(docs, PATH, capacity=64, with_ids=True).collect()
    texts, pieces, rooms = dict(rows), defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        rooms[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in rows}
    for doc_id, mine in pieces.items():
        if doc_id == 907:
            assert len(mine) == 2
            continue
        ids = []
        for n, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, len(ids))
            ids += r.ids
        assert ids == whole.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        assert all(r.length == 64 for r in sorted(mine, key=lambda r: r.piece)[:-1])
    for mine in rooms.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(rooms) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_empty_table(spark, docs_of):
    assert pack_documents(docs_of([]), PATH).collect() == []
