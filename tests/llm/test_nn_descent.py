from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skysieve.llm.nn_descent import best_lists, decode, encode, nearest_neighbours, whole_groups

SCHEMA = "vec_id long, embedding array<float>, label int, node long, code string, query int, score double, rank int"


def usable(rows):
    return [
        (i, [float(np.float32(x)) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, n):
    """Per query id its n nearest (vec_id, score); the first row by vector asks."""
    rows, out = usable(rows), {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        own = min((v, at) for at, (i, v) in enumerate(rows) if i == q)
        scored = sorted((-product(own[0], v), i) for at, (i, v) in enumerate(rows) if at != own[1])
        out[q] = [(i, -s) for s, i in scored[:n]]
    return out


def run(spark, rows, n=20, parts=3, **options):
    frame = spark.createDataFrame([(i, v, 1, 2, "c", 3, 0.5, 4) for i, v in rows], SCHEMA).repartition(parts)
    got = nearest_neighbours(frame, F.col("vec_id") % 20 == 0, n, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(map(tuple, got.collect())):
        out.setdefault(r[0], []).append(r[1:])
    assert all([x[0] for x in found] == list(range(1, len(found) + 1)) for found in out.values())
    return {q: [x[1:] for x in found] for q, found in out.items()}


def gaussian(n, width, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    return [(i, row.tolist()) for i, row in enumerate(x)]


def recall(got, want):
    assert set(got) == set(want)
    # by score: rows of equal score serve alike
    hits = sum(s >= want[q][-1][1] for q in want for _, s in got[q])
    return hits / sum(map(len, want.values()))


def test_recall_and_scores_against_brute_force(spark):
    rows = gaussian(3000, 16)
    want, got = brute(rows, 20), run(spark, rows, leaf=64, trees=2, k=12, rounds=4, beam=96)
    assert recall(got, want) >= 0.95
    vectors = dict(usable(rows))
    for q, found in got.items():
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert all(s == product(vectors[q], vectors[i]) for i, s in found)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))


def test_rounds_improve_on_the_first_lists(spark):
    rows = gaussian(2000, 24, 3)
    want = brute(rows, 20)
    start, later = (recall(run(spark, rows, leaf=32, trees=2, k=10, rounds=r, beam=24), want) for r in (0, 4))
    assert later > start + 0.1


def test_one_order_is_refused(spark):
    with pytest.raises(ValueError, match="two orders"):
        run(spark, gaussian(5, 3), trees=1)


def test_small_tables_are_whole(spark):
    for n in (1, 2, 15, 41):
        rows = gaussian(n, 5, n)
        want = brute(rows, 20)
        assert run(spark, rows) == {q: found for q, found in want.items() if found}
    assert run(spark, []) == {}


def test_a_crowd_of_equal_rows_in_a_third_of_all(spark):
    crowd = [0.5, 0.25, 0.125, 1.0, 0.0, -0.5, 2.0, 1.0]
    rows = gaussian(900, 8, 5) + [(1000 + i, crowd) for i in range(450)]
    assert recall(run(spark, rows, leaf=64, k=12, beam=64), brute(rows, 20)) >= 0.95


def test_odd_rows(spark):
    rows = gaussian(30, 4, 7) + [
        (None, [1.0] * 4), (40, None), (41, []), (42, [0.0] * 4), (43, [1.0, None]), (44, [float("nan")] * 4),
        (45, [float("inf")] * 4), (46, [3.0]), (47, [1.0] * 9), (48, [3e38] * 4), (49, [1e-38] * 4),
        (60, [1.0, 2.0, 3.0, 4.0]), (60, [1.0, 2.0, 3.0, 4.0]), (60, [0.5, 2.0, 3.0, 4.0]),
    ]
    assert run(spark, rows) == brute(rows, 20)


def test_codes_keep_directions():
    rows = [r for _, r in gaussian(50, 16, 9)]
    rows = [[x * 10.0 ** (i % 7 - 3) for x in r] for i, r in enumerate(rows)]
    unit = max(abs(x) for r in rows for x in r)
    back = decode(encode(rows, 20, unit), 20) * unit
    for row, got in zip(rows, back):
        assert np.allclose(got[:16], row, atol=max(map(abs, row)) / 250) and not got[16:].any()


def test_groups_are_never_cut():
    keys = np.repeat(np.arange(40), np.random.default_rng(2).integers(1, 9, 40))
    batches = pa.table({"k": keys}).to_batches(max_chunksize=7)
    parts = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k", 20)]
    assert sum(parts, []) == keys.tolist()
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))


def test_best_lists_merge_and_mark_what_is_new(spark):
    old = spark.createDataFrame([(1, 2, 0.5, True), (1, 3, 0.25, True)], "a long, b long, score float, fresh boolean")
    found = spark.createDataFrame([(1, 2, 0.5), (1, 4, 0.75), (1, 4, 0.75), (1, 5, 0.125), (9, 1, 0.5)], "a long, b long, score float")
    got = sorted(map(tuple, best_lists(old, found, 2).collect()))
    assert got == [(1, 2, 0.5, False), (1, 4, 0.75, True), (9, 1, 0.5, True)]
