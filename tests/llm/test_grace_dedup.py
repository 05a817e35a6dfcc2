from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from skysieve.llm.grace_dedup import ContentTable, drop_copies, grace_dedup, normalised


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[plain(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "é", "日"]) * rng.randint(0, 3) + rng.choice([" ", "  ", "\t\n", ""]) + "x" * rng.randint(0, 9)) for i in range(n)]
    rows += [(1000 + i, "hot text  again") for i in range(n)]
    return rows + [(5, None), (None, ""), (None, "only null"), (7, "twice"), (7, "twice"), (8, " "), (9, "\n"), (10, "\x1fa\xa0b")]


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a \n", "\t a\v\fb\r", "a\x1fb c\xa0d", "x" * 1000])
def test_normalised(text):
    assert normalised(text.encode()).decode() == plain(text)


def test_table_finds_equal_contents_only(spark):
    table = ContentTable(2)
    rng, seen = random.Random(1), {}
    for _ in range(3000):
        content = str(rng.randint(0, 900)).encode()
        assert table.place(content) == seen.setdefault(content, len(seen))


def test_matches_brute_force(spark, docs_of):
    rows = corpus()
    assert found(grace_dedup(docs_of(rows))) == brute(rows)


def test_buckets_that_do_not_fit_go_through_more_levels(spark, docs_of):
    rows = corpus(3) + [(5000 + i, "long " * 200 + str(i % 40)) for i in range(120)]
    assert found(grace_dedup(docs_of(rows, 5), bucket_bytes=200_000, table_bytes=3_000)) == brute(rows)


def test_rows_that_stay(spark, docs_of):
    rows = corpus(4) + [(7, "other text, same id")]
    docs = docs_of(rows).selectExpr("*", "1 as keep", "2 as record")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    want = {(keep, sha) for _, keep, _, _, sha in brute(rows)}
    got = [(r.doc_id, hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark, docs_of):
    assert grace_dedup(docs_of([])).collect() == [] and drop_copies(docs_of([])).collect() == []
