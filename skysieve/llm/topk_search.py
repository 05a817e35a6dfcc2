"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, one term per component. Queries and candidates are dealt into
blocks by the hash of their id; each pair of blocks is one group of a shuffle. Inside a group the candidates form
an inverted index (a posting list of places and weights per term), and each query row goes through its own terms,
scattering weight times posting into a dense array of scores. The best k of a block are taken by partition
selection; a window over all blocks of a query merges them. Every pair of a query and a candidate is scored.

Nulls and odd input: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
with a null id. Vectors of different lengths are compared on their common terms. Weights outside 64 bits saturate
and sums wrap, as long arithmetic does. Rows that repeat an id are one vector each as candidates and are all left
out for queries of that id; of repeated query rows the one with the smallest vector is asked. Ties go to the
smaller id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skysieve.session import materialise

#: Rows of a block of candidates and of queries; candidates that are scored at once.
CANDIDATES, QUERIES, CHUNK = 8192, 4096, 4096
#: A posting list with more than this share of the chunk is kept as a full row.
FULL = 0.25
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_weights(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component x, in double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their weights as a matrix filled with zeros."""
    ids = rows.column("vec_id").to_numpy()
    lists = rows.column("weights").combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends, prepend=0)
    dense = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    dense[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], dense[order]


def _postings(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: places and weights; no places if the list is kept as a full row."""
    lists = []
    for term in range(block.shape[1]):
        column = np.ascontiguousarray(block[:, term])
        places = np.flatnonzero(column)
        lists.append((None, column) if len(places) > FULL * len(column) else (places, column[places]))
    return lists


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[list, list, list]:
    """The k best candidates of a block for each query, in no order; ids are sorted."""
    if len(vectors) and len(queries):
        # in Python's integers: the absolute value of the least long is no long
        most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (queries, vectors)]
        # 32 bits are exact if no sum can leave them
        if max(*most, most[0] * most[1] * min(queries.shape[1], vectors.shape[1])) < 2**31:
            queries, vectors = queries.astype(np.int32), vectors.astype(np.int32)
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(ids), CHUNK):
        chunk, places = ids[a : a + CHUNK], vectors[a : a + CHUNK]
        postings = _postings(places)
        scores, product = np.empty(len(chunk), places.dtype), np.empty(len(chunk), places.dtype)
        for query_id, row in zip(query_ids, queries):
            scores[:] = 0
            for term in np.flatnonzero(row[: len(postings)]):
                at, weights = postings[term]
                if at is None:
                    np.multiply(weights, row[term], out=product)
                    scores += product
                else:
                    scores[at] += weights * row[term]
            own = slice(*np.searchsorted(chunk, [query_id, query_id + 1]))
            left = len(chunk) - (own.stop - own.start)
            take = np.ones(len(chunk), bool)
            take[own] = False
            if left > k:
                valid = scores[take]
                cut = np.partition(valid, left - k)[left - k]
                above = take & (scores > cut)
                ties = np.flatnonzero(take & (scores == cut))[: k - int(above.sum())]
                chosen = np.concatenate([np.flatnonzero(above), ties])
            else:
                chosen = np.flatnonzero(take)
            out[0].append(np.full(len(chosen), query_id))
            out[1].append(chunk[chosen])
            out[2].append(scores[chosen].astype(np.int64))
    return out


def _score_blocks(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return FOUND.empty_table()
        parts = best_of_block(*_matrix(queries), *_matrix(candidates), k)
        return pa.table([pa.array(np.concatenate(p)) if p else pa.array([], pa.int64()) for p in parts], schema=FOUND)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
    vector: str = "embedding", candidate_rows: int = CANDIDATES, query_rows: int = QUERIES,
) -> DataFrame:
    """Per query its k best other rows: query_id, rank (from 1), vec_id, score."""
    rows = materialise(
        vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(
            F.col(vec_id).cast("long").alias("vec_id"), integer_weights(vector, scale).alias("weights"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ),
        "topk-rows",
    )
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counts, (candidate_rows, query_rows)))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("weights").alias("weights"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "weights", dealt(query_blocks, 1).alias("q"), every(blocks).alias("c"))
    right = rows.select("vec_id", "weights", dealt(blocks, 2).alias("c"), every(query_blocks).alias("q"))
    found = (
        left.groupBy("q", "c")
        .cogroup(right.groupBy("q", "c"))
        .applyInArrow(_score_blocks(k), "query_id long, vec_id long, score long")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
