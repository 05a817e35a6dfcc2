from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skysieve.llm.topk_search import best_of_block, top_k


def brute(rows, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        w = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return out


def run(spark, rows, k, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, top_k(frame, F.col("vec_id") % 20 == 0, k, **options).collect()))


def vectors(n, dims, seed=0, steps=8):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, 0.0, rng.randint(-steps, steps) / 16]) for _ in range(dims)]) for i in range(n)]


def test_matches_brute_force_with_ties_over_blocks(spark):
    rows = vectors(400, 6, steps=2) + [(1000 + i, [0.25] * 6) for i in range(60)]
    assert run(spark, rows, 7, candidate_rows=50, query_rows=6) == brute(rows, 7)


def test_fewer_rows_than_k(spark):
    rows = vectors(12, 4, 2)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_unusable_vectors_and_lengths(spark):
    rows = vectors(60, 5, 3) + [
        (80, None), (100, []), (120, [None, 1.0]), (140, [math.nan]), (160, [math.inf, 0.0]), (None, [1.0]), (180, [1.0, 2.0]), (181, [0.5] * 9),
    ]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_repeated_ids(spark):
    rows = vectors(40, 3, 5) + [(20, [1.0, 0.0, 1.0]), (20, [0.5, 0.5, 0.5]), (3, [1.0, 1.0, 1.0])]
    assert run(spark, rows, 6, candidate_rows=16) == brute(rows, 6)


def test_weights_beyond_32_bits(spark):
    rows = [(0, [3e4, 1.0]), (1, [4e4, 2.0]), (2, [-4e4, 2.0]), (20, [1e5, -1e5])]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_empty_table_extra_columns_and_no_query(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])], 3) == []
    frame = spark.createDataFrame([(20, [1.0], 1, 2)], "vec_id long, embedding array<float>, q int, weights int")
    assert top_k(frame, F.col("vec_id") == 20).collect() == []


def test_least_weight_keeps_64_bits():
    least, ids = -(2**63), np.array([1, 2])
    _, found, scores = best_of_block(np.array([9]), np.array([[1, 0]]), ids, np.array([[least, 0], [3, 0]]), 2)
    got = dict(zip(np.concatenate(found).tolist(), np.concatenate(scores).tolist()))
    assert got == {1: least, 2: 3}
