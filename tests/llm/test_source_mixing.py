from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import pytest

from skysieve.llm import source_mixing
from skysieve.llm.source_mixing import mix_sources, mixed_documents, targets

SPLIT = r"[^\x20\x09-\x0D]+"


def size(text):
    return len(re.findall(SPLIT, text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Shares by weight; what is above a limit goes to the others until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > limit * sizes[s]]
        if not above:
            return target | stopped
        stopped |= {s: limit * sizes[s] for s in above}


def key(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def documents(seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))), "en", rng.choice(["a", "b", "B", "ü", "", None, "hot", "hot", "hot"]), 5) for i in range(400)]
    return rows + [(1000, None, None, "a", None), (None, "x  y\tz", "en", "b", 1), (1001, " \n", "en", "b", 1), (1002, "w " * 3000, "en", "hot", 1)]


def test_targets_and_cuts_match_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(source_mixing, "RANGE_ROWS", 16)
    rows = documents()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    targets = brute_targets(sizes)
    want = {}
    for source in sizes:
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: (key(r[0]), r[0] or 0))
        budget, before = floor(targets[source] + 1e-9), 0
        whole = budget // sizes[source] if sizes[source] else 0
        for doc_id, text, *_ in mine:
            n = size(text)
            want[doc_id] = n, whole * n + max(0, min(n, budget - whole * sizes[source] - before))
            before += n
    got = mix_sources(docs_of(rows)).collect()
    assert {r.doc_id: (r.size, r.taken) for r in got} == want
    by_source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.target == pytest.approx(targets[by_source[r.doc_id]]) and r.source_size == sizes[by_source[r.doc_id]]
        assert r.taken <= 2 * r.size
    taken = Counter()
    for r in got:
        taken[by_source[r.doc_id]] += r.taken
    assert all(0 <= targets[s] - taken[s] < 1 for s in sizes)


@pytest.mark.parametrize("counts", [(50, 50, 50, 50), (5, 200, 30, 90, 90, 90), (100, 1, 1, 1, 1, 1, 1), (7,), (0, 10, 20)])
def test_targets_share_all_words(spark, counts):
    rows = [(f"s{i}", 1) for i, n in enumerate(counts) for _ in range(n)] + [(f"s{i}", 0) for i in range(len(counts))]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(brute_targets({f"s{i}": n for i, n in enumerate(counts)}))
    assert sum(got.values()) == pytest.approx(1.5 * sum(counts))


def test_reruns_agree_whatever_the_partitions(spark, docs_of):
    rows = documents(1) + [(7, "a b c", "en", "a", 1)] * 5
    first, again = (sorted(map(tuple, mix_sources(docs_of(rows, n)).collect()), key=str) for n in (2, 7))
    assert first == again


def test_mixed_documents_hold_the_words_taken(spark, docs_of):
    rows = documents(2)
    docs = docs_of(rows).withColumnRenamed("lang", "size")  # a clashing name
    taken = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    held = Counter()
    texts = {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        held[r.doc_id] += size(r.text)
        assert re.findall(SPLIT, texts[r.doc_id])[: size(r.text)] == re.findall(SPLIT, r.text)
    assert held == Counter({d: n for d, n in taken.items() if n})


def test_empty_and_wordless_tables(spark, docs_of):
    assert mix_sources(docs_of([])).collect() == []
    assert mixed_documents(docs_of([])).collect() == []
    rows = mix_sources(docs_of([(1, None, "en", "a", 1), (2, " ", "en", None, 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixed_documents(docs_of([(1, None, "en", "a", 1)])).collect() == []
