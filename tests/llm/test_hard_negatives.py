from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skysieve.llm.hard_negatives import block_scores, hard_negatives, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score double, dealt int"


def brute(rows, positives=5, negatives=10):
    usable = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a in sorted({i for i, _, _ in usable if i % 100 == 0}):
        label, w = min((lab, v) for i, lab, v in usable if i == a)
        scored = sorted((-sum(x * y for x, y in zip(w, v)), i, lab) for i, lab, v in usable if i != a)
        for ps, p, _ in [r for r in scored if r[2] == label][:positives]:
            hits = [(n, s) for s, n, lab in scored if lab != label and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, rank, n, -ps, -s) for rank, (n, s) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, **options):
    full = [(i, v, label, "x", 1.0, 2) for i, v, label in rows]
    frame = spark.createDataFrame(full, SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 100 == 0, **options).collect()))


def vectors(n, dims=6, seed=0, labels=3, step=4, spread=1.0):
    rng = random.Random(seed)
    return [
        (i * 10, [spread * rng.randint(-step, step) / 16 for _ in range(dims)], rng.randrange(labels)) for i in range(n)
    ]


def test_matches_brute_force_over_blocks_with_ties(spark):
    rows = vectors(300, step=2)
    assert run(spark, rows, candidate_rows=40, anchor_rows=4) == brute(rows)


def test_scores_of_zero_and_below(spark):
    # positives of score zero: negatives of score zero and a smaller id belong to them
    rows = [(100, [1.0, 0.0], 1), (7, [0.0, 1.0], 2), (8, [0.0, 2.0], 1), (9, [-1.0, 0.0], 1), (3, [0.0, 3.0], 2), (4, [-1.0, 0.0], 2)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [(r[1], r[3]) for r in got] == [(8, 3), (8, 7)]


def test_odd_rows(spark):
    rows = vectors(120, 4, 5) + [
        (None, [1.0] * 4, 1), (100, [0.5] * 4, 0), (100, [0.5, 0.25, 0.5, 0.5], 0), (33, None, 1), (44, [1.0, None, 1.0, 1.0], 1),
        (55, [float("nan")] * 4, 1), (56, [float("inf")] * 4, 1), (77, [0.5] * 4, None), (88, [], 1), (89, [0.5], 2),
        (91, [0.5] * 40, 0), (92, [0.25] * 4, 2), (92, [0.25] * 4, 2), (92, [0.25] * 4, 2),
    ]
    assert run(spark, rows, candidate_rows=30, anchor_rows=3) == brute(rows)


def test_one_id_or_label_in_a_third_of_all_rows(spark):
    rows = vectors(200, 4, 9) + [(15, [0.25, 0.25, 0.0, 0.0], 1)] * 60 + [(1000 + 7 * i, [0.125 * (i % 3), 0.25, 0.0, 0.5], 2) for i in range(100)]
    assert run(spark, rows, candidate_rows=50, anchor_rows=5) == brute(rows)


def test_weights_beyond_exact_doubles(spark):
    rows = vectors(60, 4, 3, spread=2.0**22)
    assert run(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert run(spark, [(100, [1.0], 0), (2, [1.0], 1)]) == []  # no positive


def test_windows_must_follow_their_positive(spark):
    for low, high in (((9, 10), (3, 10)), ((3, 10), (11, 10)), ((-1, 10), (3, 10))):
        with pytest.raises(ValueError, match="windows"):
            run(spark, [(100, [1.0], 0)], low=low, high=high)


longs = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(longs, longs, longs), min_size=1, max_size=20))
def test_packed_keys_sort_like_their_parts(rows):
    a, s, i = (np.array(c, np.int64) for c in zip(*rows))
    keys = packed(a, s, 1, i).to_pylist()
    assert [unpacked(k) for k in keys] == [(x, y, 1, z) for x, y, z in rows]
    assert sorted(range(len(rows)), key=lambda n: keys[n]) == sorted(range(len(rows)), key=lambda n: (rows[n][0], -rows[n][1], rows[n][2]))


def test_scores_wrap_like_longs():
    one = pa.array([[2**62, 3], [1, 1]], pa.list_(pa.int64()))
    assert block_scores(one, one).tolist() == [[9, 2**62 + 3], [2**62 + 3, 2]]
