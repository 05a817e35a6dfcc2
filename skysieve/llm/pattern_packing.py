"""Best-fit packing: pattern packing by non-negative least squares.

Pieces of equal length are interchangeable, so packing needs only the histogram of lengths, which has as many
bins as a sequence has tokens. Patterns of few documents that fill a sequence exactly are enumerated: all pairs,
and the triples whose smallest length lies on a grid. Repeat counts are fitted to the histogram by non-negative
least squares and rounded; what is left is packed by best fit, longest first. The plan says for each length which
ranks go to which pattern; pieces get their rank within their length by windows over salted lengths, so a length
that many pieces share is spread over tasks, and look their place up in the plan.

Nulls and odd input: a null text counts as empty and is the end token alone. Rows that repeat an id are documents
of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skysieve.llm.shared import slices, utf8
from skysieve.llm.tokens import WordIds
from skysieve.session import materialise

#: Grid of the smallest length in a triple, steps of the fit, weight of lengths up to SMALL (residuals that fill gaps).
GRID, STEPS, SMALL, SMALL_WEIGHT = 16, 300, 64, 0.1
#: Pieces of one length that one window ranks, on average.
RANK_ROWS = 128
#: A run of equal lengths in a pattern: ranks [rank, rank + count) of the length, `each` in a sequence.
RUN = ("length", "rank", "count", "each", "sequence", "offset")


def exact_patterns(capacity: int, grid: int = GRID) -> np.ndarray:
    """Rows of three lengths, longest first, that fill a sequence exactly; 0 for none."""
    rows = [np.array([[capacity, 0, 0]])]
    b = np.arange(1, capacity // 2 + 1)
    rows.append(np.stack([capacity - b, b, 0 * b], axis=1))
    for c in range(grid, capacity // 3 + 1, grid):
        b = np.arange(c, (capacity - c) // 2 + 1)
        rows.append(np.stack([capacity - c - b, b, 0 * b + c], axis=1))
    return np.concatenate(rows)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts that come closest to the histogram, by accelerated projected gradients."""
    weights = np.ones(len(histogram))
    weights[: SMALL + 1] = SMALL_WEIGHT
    weights[0] = 0
    scale = max(1, histogram.max())
    goal = histogram / scale

    def lengths(x):
        out = np.zeros(len(histogram))
        for column in patterns.T:
            out += np.bincount(column, x, len(histogram))
        return out

    def back(r):
        return sum(r[column] for column in patterns.T)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(weights * lengths(v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-300)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weights * (lengths(y) - goal)) / (1.05 * max(top, 1e-9)))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x * scale


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The histogram packed longest first, each piece where the least room stays: (runs of (length, each), repeats)."""
    room: dict[int, list[list]] = {}  # sequences that are still open, by room
    order: list[int] = []
    closed = []

    def put(runs: tuple, n: int, left: int) -> None:
        if left == 0:
            closed.append((runs, n))
        elif left in room:
            room[left].append([runs, n])
        else:
            room[left] = [[runs, n]]
            insort(order, left)

    for length in range(len(histogram) - 1, 0, -1):
        n = int(histogram[length])
        while n:
            at = bisect_left(order, length)
            if at < len(order):
                left = order[at]
                runs, m = room[left].pop()
                if not room[left]:
                    del room[left], order[at]
            else:
                left, runs, m = capacity, (), n
            each = min(left // length, n)
            full = min(m, n // each)
            put((*runs, (length, each)), full, left - each * length)
            if runs and m > full:
                put(runs, m - full, left)
            n -= each * full
    return closed + [(runs, n) for groups in room.values() for runs, n in groups]


def plan_packing(histogram: np.ndarray, capacity: int, grid: int = GRID, steps: int = STEPS) -> np.ndarray:
    """Where each rank of each length goes: rows of RUN, in the order of length and rank."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    packed: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left.sum():
        patterns = exact_patterns(capacity, grid)
        patterns = patterns[(left[patterns[:, 0]] > 0) & ((patterns[:, 1:] == 0) | (left[patterns[:, 1:]] > 0)).all(axis=1)]
        if len(patterns):
            # running sums are rounded, so that small counts of neighbouring patterns are not all lost
            total = np.floor(np.cumsum(fit_repeats(patterns, left, steps)) + 0.5).astype(np.int64)
            for i in np.flatnonzero(np.diff(total, prepend=0)):
                want = int(total[i] - (total[i - 1] if i else 0))
                used, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
                n = min(want, int((left[used] // times).min()))
                if n:
                    left[used] -= times * n
                    packed.append((tuple((int(a), int(b)) for a, b in zip(used[::-1], times[::-1])), n))
        packed += best_fit(left, capacity)
    ranks, sequence, rows = np.zeros(len(histogram), np.int64), 0, []
    for runs, n in packed:
        offset = 0
        for length, each in runs:
            rows.append((length, ranks[length], n * each, each, sequence, offset))
            ranks[length] += n * each
            offset += length * each
        sequence += n
    plan = np.array(rows, np.int64).reshape(-1, len(RUN))
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(path), array("I", [end_id]).tobytes()
        size = 4 * capacity
        for batch in slices(batches):
            ids, out, held = batch.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, utf8(batch, "text")):
                tokens = words.ids(text) + end
                for piece, a in enumerate(range(0, len(tokens), size)):
                    part = tokens[a : a + size]
                    out.append((doc_id, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    return run


def _place(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, each, sequence, offset = plan.T
        keys = (length << 44) + rank
        for batch in batches:
            mine, at = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, (mine << 44) + at, side="right") - 1
            nth = at - rank[run]
            places = (sequence[run] + nth // each[run], offset[run] + nth % each[run] * mine)
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names] + [pa.array(p) for p in places]
            yield pa.record_batch(columns, [*names, "sequence_id", "offset"])

    return run


def pack_documents(
    documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for.

    `tokenizer` is the path of a tokenizer file that the executors can read.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialise(docs.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema), "pack-pieces")
    counted = pieces.groupBy("length").count().collect()  # as many rows as a sequence has tokens, at most
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["count"]
    plan = plan_packing(histogram, capacity)
    salts = {n: -(-int(c) // RANK_ROWS) for n, c in enumerate(histogram) if c > RANK_ROWS}
    many = F.coalesce(F.create_map(*[F.lit(x) for p in salts.items() for x in p])[F.col("length").cast("int")], F.lit(1)) if salts else F.lit(1)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), many))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("length", "salt").count()
    starts = starts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_rank"))
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1
    ranked = rows.withColumn("nth", nth).join(starts, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("start_rank") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(plan), schema + ", sequence_id long, offset long")
