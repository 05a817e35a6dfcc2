"""Hard negatives by a secondary sort: pair scores travel in packed keys (anchor, descending score, id).

Every anchor meets every other row in blocks: anchors and candidates are dealt into blocks, and one group of a shuffle
scores one block against another by a matrix product. A first pass keeps each anchor's best rows of its own label, its
positives. A positive opens a window of scores; a second pass packs the scores that fall into an anchor's windows. Of
a block no more than the first `negatives` rows of each window can be among the first of all blocks, so each block sends
just these: none that counts is left out, and what is shuffled does not grow with the pairs. The keys are dealt by
anchor and sorted inside partitions (`repartition` and `sortWithinPartitions`, the DataFrame form of
repartitionAndSortWithinPartitions). One iterator then reads each partition as a stream: a positive opens its window, a
negative goes to every open window that takes it, and a window is shut when it is full. It holds a few numbers per
window and never the rows of an anchor.

A key has 25 bytes: the anchor's id, the score turned round, 0 for a positive and 1 for a negative, the row's id; all
big-endian and shifted so that bytes sort as numbers do. A positive precedes negatives of its own score, so it opens
in time as long as windows end at or below the positive's score.

Nulls and odd input: rows with a null id, label or vector, or with a null or non-finite component take no part. An empty
vector scores zero. Vectors of different lengths are compared on their common components. Weights outside 64 bits
saturate and sums wrap, as long arithmetic does. Rows that repeat an id are rows of their own, and none of them counts
for an anchor of that id; of repeated anchors the one with the smallest label, then vector, is asked. Ties go to the
smaller id. Very long vectors make larger blocks, nothing else. An empty table, one label only, or anchors without a
positive give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skysieve.llm.topk_search import integer_weights
from skysieve.session import materialise

#: Rows of a block of candidates and of anchors.
CANDIDATES, ANCHORS = 8192, 1024
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
_FOUND = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_PACKED = pa.schema([("anchor_id", pa.int64()), ("key", pa.binary())])
_TOP = np.uint64(1 << 63)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    dense = np.zeros((len(sizes), width), np.int64)
    dense[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return dense


def block_scores(one: pa.ListArray, two: pa.ListArray) -> np.ndarray:
    """Integer inner products of all rows of one block with all of the other."""
    width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (one, two))
    a, b = _matrix(one, width), _matrix(two, width)
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b)]
    if most[0] * most[1] * max(1, width) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _lists(rows: pa.Table, name: str) -> pa.ListArray:
    return pa.concat_arrays(rows.column(name).chunks)


def _first(ids: np.ndarray, scores: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Of the chosen places the n with the highest scores, ties by the smaller id."""
    if len(chosen) > n:
        cut = np.partition(scores[chosen], len(chosen) - n)[len(chosen) - n]
        chosen = chosen[scores[chosen] >= cut]
    # ~x falls where x rises, for the least long too
    return chosen[np.lexsort((ids[chosen], ~scores[chosen]))][:n]


def _positives(n: int):
    """Per anchor of a block the first `n` rows of its label in a block of candidates."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _FOUND.empty_table()
        ids, labels = _column(rows, "vec_id"), _column(rows, "label")
        scores, out = block_scores(_lists(anchors, "weights"), _lists(rows, "weights")), []
        for anchor, label, found in zip(_column(anchors, "vec_id"), _column(anchors, "label"), scores):
            chosen = _first(ids, found, np.flatnonzero((labels == label) & (ids != anchor)), n)
            out.append((np.full(len(chosen), anchor), ids[chosen], found[chosen]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)

    return run


def window(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest integer n with low * score <= n <= high * score, for fractions low and high."""
    return -((-low[0] * score) // low[1]), (high[0] * score) // high[1]


def packed(anchors: np.ndarray, scores: np.ndarray, side: int, ids: np.ndarray) -> pa.Array:
    """Keys of 25 bytes whose order is anchor, descending score, side, id."""
    out = np.empty((len(ids), 25), np.uint8)
    up = lambda x: (x.astype(np.int64).view(np.uint64) ^ _TOP).astype(">u8")
    out[:, :8] = up(anchors).view(np.uint8).reshape(-1, 8)
    out[:, 8:16] = (~up(scores).astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = side
    out[:, 17:] = up(ids).view(np.uint8).reshape(-1, 8)
    flat = np.ascontiguousarray(out).tobytes()
    return pa.Array.from_buffers(pa.binary(25), len(ids), [None, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    at = lambda a: int.from_bytes(key[a : a + 8], "big")
    return at(0) - (1 << 63), (1 << 63) - 1 - at(8), key[16], at(17) - (1 << 63)


def _negatives(n: int, low: tuple[int, int], high: tuple[int, int]):
    """Per anchor of a block, keys of the first `n` rows of other labels in each of its windows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _PACKED.empty_table()
        ids, labels = _column(rows, "vec_id"), _column(rows, "label")
        scores = block_scores(_lists(anchors, "weights"), _lists(rows, "weights"))
        asked, keys = [], []
        facts = (_column(anchors, "vec_id"), _column(anchors, "label"), anchors.column("opened").to_pylist())
        for anchor, label, opened, found in zip(*facts, scores):
            other, take = (labels != label) & (ids != anchor), set()
            for score in set(opened):
                a, b = window(score, low, high)
                if a <= b and b >= -(2**63) and a < 2**63:
                    inside = (found >= max(a, -(2**63))) & (found <= min(b, 2**63 - 1))
                    take.update(_first(ids, found, np.flatnonzero(other & inside), n).tolist())
            chosen = np.array(sorted(take), np.int64)
            asked.append(np.full(len(chosen), anchor))
            keys.append(packed(asked[-1], found[chosen], 1, ids[chosen]))
        return pa.table([pa.array(np.concatenate(asked)), pa.concat_arrays(keys)], schema=_PACKED)

    return run


def _pack_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, scores, ids = (batch.column(c).to_numpy() for c in ("anchor_id", "score", "vec_id"))
        yield pa.record_batch([batch.column("anchor_id"), packed(anchors, scores, 0, ids)], schema=_PACKED)


#: Rows of the result that are sent on at once.
SENT = 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _stream(n: int, low: tuple[int, int], high: tuple[int, int]):
    """Sorted keys in, negatives per positive out; the state is the open windows of one anchor."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_windows, rows = None, [], []
        for batch in batches:
            for key in batch.column("key").to_pylist():
                anchor, score, side, found = unpacked(key)
                if anchor != current:
                    current, open_windows = anchor, []
                if side == 0:
                    open_windows.append([found, score, *window(score, low, high), 0])
                    continue
                for w in open_windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        rows.append((anchor, w[0], w[4], found, w[1], score))
                open_windows = [w for w in open_windows if w[4] < n]
            if len(rows) >= SENT:
                yield sent(rows)
                rows = []
        if rows:
            yield sent(rows)

    return run


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100), scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
    label: str | Column = "label", candidate_rows: int = CANDIDATES, anchor_rows: int = ANCHORS,
) -> DataFrame:
    """Per anchor and positive its first rows of other labels whose score is between low and high times the positive's.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    if not (low[1] > 0 and high[1] > 0 and 0 <= low[0] and low[0] * high[1] < high[0] * low[1] and high[0] <= high[1]):
        raise ValueError("windows must hold 0 <= low < high <= 1, or a negative could precede its positive")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.col(vec_id).isNotNull() & label.isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        integer_weights(vector, scale).alias("weights"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        # dealt by the place of a row, so that rows that repeat an id spread too; fixed by being written
        F.xxhash64(F.monotonically_increasing_id()).alias("dealt"),
    )
    rows = materialise(rows, "negatives-rows")
    n_rows, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, asked_blocks = max(1, -(-n_rows // candidate_rows)), max(1, -(-n_asks // anchor_rows))
    one = F.min(F.struct("label", "weights")).alias("one")
    asked = rows.where("asks").groupBy("vec_id").agg(one).select(F.col("vec_id").alias("vec_id"), "one.*")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asked_blocks)).cast("int")
    right = rows.select(
        "vec_id", "label", "weights", F.pmod("dealt", F.lit(blocks)).cast("int").alias("c"), every(asked_blocks).alias("q")
    ).groupBy("q", "c")

    def met(anchors: DataFrame, score, schema: str) -> DataFrame:
        left = anchors.withColumns({"q": place, "c": F.lit(0)}).withColumn("c", every(blocks))
        return left.groupBy("q", "c").cogroup(right).applyInArrow(score, schema)

    best = met(asked, _positives(positives), "anchor_id long, vec_id long, score long")
    order = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", order).where(F.col("place") <= positives).drop("place")
    best = materialise(best, "negatives-positives")
    opened = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("opened"))
    schema = "anchor_id long, key binary"
    found = met(asked.join(opened, "vec_id"), _negatives(negatives, low, high), schema)
    keys = found.unionAll(best.mapInArrow(_pack_positives, schema))
    return keys.repartition("anchor_id").sortWithinPartitions("key").mapInArrow(_stream(negatives, low, high), RESULT)
