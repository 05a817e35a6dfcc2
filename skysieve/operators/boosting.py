"""Histogram gradient boosting of all classes at once, on all rows.

One tree per class and round is grown on binned features. Up to `FIT_ROWS` rows are fitted in one task, and several such
fits, such as the folds of a validation, run as jobs side by side. More rows are dealt to tasks of one barrier stage, as
many as the cluster runs at once; each keeps its rows, binned to a byte per feature, for the whole fit. The tasks add up
their histograms through the shared folder and all take the same splits. Gradients are rounded to multiples of a power of
two whose sums are exact, so the trees do not depend on the number of tasks or on who has which row. Cuts of features
come from all rows, too. Scoring is a vectorised function over any number of rows.

Ties between splits go to the first feature and the lowest cut.
"""

from __future__ import annotations

import heapq
import io
import math
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysieve.session import scratch_path

#: Bins of a feature; cells in which its quantiles are looked for.
BINS, CELLS = 256, 1 << 10
#: Rows that one task fits alone; rows of a task at least where there are more; rows that are binned or counted at once.
FIT_ROWS, SHARE, PART = 200_000, 20_000, 1 << 15
#: Bytes from which an array of a fit lies in a file; seconds between two looks for a file of another task.
IN_MEMORY, WAIT = 1 << 26, 0.001
#: Sum of second derivatives that either side of a split has at least.
LEAST_WEIGHT = 1e-3
#: Rows and trees (about) that meet in one pass; rows that walk through a tree together.
ROWS, TREES, CHUNK = 1 << 10, 64, 1 << 13


@dataclass(frozen=True)
class Forest:
    """Trees of all rounds as arrays (tree, node): series s of K has the trees s, s + K, ...; a leaf points at itself."""

    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Forest:
        with np.load(io.BytesIO(data)) as found:
            return Forest(**{k: found[k] for k in found.files})

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores (row, series) before they become probabilities."""
        return self.scorer()(x)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """What `raw` does, to be made once for many batches: leaves are looked up, not walked to, where they fit a mask."""
        return _LeafTables(self) if self.feature.shape[1] < 2 * 64 else self.walked

    def walked(self, x: np.ndarray) -> np.ndarray:
        """The scores by walking from node to node."""
        out = np.tile(self.base, (len(x), 1))
        for start in range(0, len(x), CHUNK):
            part = x[start : start + CHUNK]
            cells, width = part.ravel(), x.shape[1]
            for t in range(len(self.feature)):
                feature, cut, left, right = self.feature[t], self.cut[t], self.left[t], self.right[t]
                at, live = np.zeros(len(part), np.int32), np.arange(len(part))
                if left[0] == 0:
                    live = live[:0]
                while len(live):  # rows that have not reached a leaf
                    node = at[live]
                    node = np.where(cells[live * width + feature[node]] <= cut[node], left[node], right[node])
                    at[live] = node
                    live = live[left[node] != node]
                out[start : start + CHUNK, t % len(self.base)] += self.value[t][at]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _probabilities(self.raw(x))


class _LeafTables:
    """Finds the leaves of many trees at once, with one table per feature instead of a walk.

    The leaves of a tree are bits, leftmost first. A row that is above the cut of a node loses the leaves on that node's
    left, so a table gives, per place of a value among the cuts of its feature and per tree, the leaves that are left.
    The lowest bit that all features leave is the leaf of the row. Sums are taken tree by tree, as in a walk.
    """

    def __init__(self, forest: Forest):
        feature, left, right = forest.feature, forest.left, forest.right
        trees, size = feature.shape
        every, inner = np.arange(trees), left != np.arange(size)
        leaves, first = np.ones((trees, size), np.int64), np.zeros((trees, size), np.int64)
        used = np.zeros((trees, size), bool)
        used[:, 0] = True
        for node in reversed(range(size)):  # children come after their parent
            both = leaves[every, left[:, node]] + leaves[every, right[:, node]]
            leaves[:, node] = np.where(inner[:, node], both, 1)
        for node in range(size):
            at = np.flatnonzero(inner[:, node] & used[:, node])
            one, two = left[at, node], right[at, node]
            used[at, one] = used[at, two] = True
            first[at, one], first[at, two] = first[at, node], first[at, node] + leaves[at, one]
        self.base, self.width = forest.base, int(leaves[:, 0].max())
        kind = np.uint32 if self.width <= 32 else np.uint64
        tree, node = np.nonzero(used & ~inner)
        values = np.zeros((trees, self.width))
        values[tree, first[tree, node]] = forest.value[tree, node]
        tree, node = np.nonzero(used & inner)
        lost = leaves[tree, left[tree, node]].astype(np.uint64)  # of an inner node, so less than all 64
        rest = ~(((np.uint64(1) << lost) - np.uint64(1)) << first[tree, node].astype(np.uint64))
        self.cuts, tables = {}, {}
        for f in np.unique(feature[tree, node]).tolist():
            mine = feature[tree, node] == f
            self.cuts[f], place = np.unique(forest.cut[tree, node][mine], return_inverse=True)
            table = np.full((len(self.cuts[f]) + 1, trees), np.iinfo(kind).max, kind)
            np.bitwise_and.at(table, (place + 1, tree[mine]), rest[mine].astype(kind))
            tables[f] = np.bitwise_and.accumulate(table, axis=0)
        step = len(self.base) * -(-TREES // len(self.base))
        self.blocks = [
            ({f: np.ascontiguousarray(t[:, a : a + step]) for f, t in tables.items()}, values[a : a + step].ravel())
            for a in range(0, trees, step)
        ]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, series = np.tile(self.base, (len(x), 1)), len(self.base)
        if not self.cuts:  # each tree is one leaf
            for _, values in self.blocks:
                for t in range(0, len(values), series):
                    out += values[t : t + series]
            return out
        places = {f: np.searchsorted(cuts, x[:, f]) for f, cuts in self.cuts.items()}
        for tables, values in self.blocks:
            trees = len(values) // self.width
            offset, one = np.arange(trees) * self.width, next(iter(tables.values())).dtype.type(1)
            for start in range(0, len(x), ROWS):
                part = slice(start, start + ROWS)
                left = None
                for f, table in tables.items():
                    found = table.take(places[f][part], axis=0)
                    left = found if left is None else np.bitwise_and(left, found, out=left)
                leaf = np.bitwise_count(~left & (left - one))  # the zeros below the lowest bit
                added, sums = values.take(leaf + offset), out[part]
                for t in range(0, trees, series):
                    sums += added[:, t : t + series]
        return out


def _probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))
        return np.hstack([1.0 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Cuts between neighbouring values, at quantiles where there are too many; a value <= a cut lies left of it."""
    distinct = np.unique(values)
    if len(distinct) > BINS:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
    return (distinct[:-1] + distinct[1:]) / 2


def best_split(h: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best split of a leaf with the histogram `h`."""
    left = h.cumsum(axis=2)
    right = left[:, :, -1:] - left
    (g, w, n), (gr, wr, nr) = left, right
    gain = g * g / (w + 1e-12) + gr * gr / (wr + 1e-12)
    enough = (np.minimum(n, nr) >= least) & (np.minimum(w, wr) >= LEAST_WEIGHT)
    gain = np.where(enough, gain, -np.inf)
    best = int(gain.argmax())
    whole = left[:, 0, -1]
    return gain.flat[best] - whole[0] ** 2 / (whole[1] + 1e-12), *divmod(best, BINS)


class _Grower:
    """Grows trees leaf by leaf, the leaf with the largest gain first."""

    def __init__(self, x: np.ndarray, leaves: int, depth: int | None, least: int):
        self.edges = [bin_edges(c) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        self.codes, self.flat = codes, codes + np.arange(x.shape[1]) * BINS
        self.leaves, self.depth, self.least = leaves, depth or leaves, least

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        at, n = self.flat[rows].ravel(), self.flat.shape[1]
        sums = [np.bincount(at, w, n * BINS) for w in (np.repeat(self.grad[rows], n), np.repeat(self.hess[rows], n))]
        return np.stack([*sums, np.bincount(at, minlength=n * BINS)]).reshape(3, n, BINS)

    def tree(self, grad: np.ndarray, hess: np.ndarray, rate: float):
        """Arrays of one tree, its depth, and what it adds to each row."""
        self.grad, self.hess = grad, hess
        size = 2 * self.leaves - 1
        feature, left = np.zeros(size, np.int32), np.arange(size, dtype=np.int32)
        right, cut, value = left.copy(), np.full(size, np.inf), np.zeros(size)
        added, deep, used, ends = np.zeros(len(grad)), 0, 1, 1
        heap: list = []

        def offer(node, rows, h, level):
            can = level < self.depth and len(rows) >= 2 * self.least
            gain, f, b = best_split(h, self.least) if can else (0.0, 0, 0)
            heapq.heappush(heap, (-gain if gain > 1e-10 else 0.0, node, rows, h, level, f, b))

        everything = np.arange(len(grad))
        offer(0, everything, self.histogram(everything), 0)
        while heap:
            gain, node, rows, h, level, f, b = heapq.heappop(heap)
            if gain == 0.0 or ends == self.leaves:
                value[node] = -rate * grad[rows].sum() / (hess[rows].sum() + 1e-12)
                added[rows] = value[node]
                continue
            goes = self.codes[rows, f] <= b
            sides = rows[goes], rows[~goes]
            small = int(len(sides[1]) < len(sides[0]))
            part = self.histogram(sides[small])
            hists = (part, h - part) if small == 0 else (h - part, part)
            feature[node], cut[node], left[node], right[node] = f, self.edges[f][b], used, used + 1
            deep, ends = max(deep, level + 1), ends + 1
            for side in (0, 1):
                offer(used + side, sides[side], hists[side], level + 1)
            used += 2
        return (feature, cut, left, right, value), deep, added


def _base(prior: np.ndarray) -> np.ndarray:
    return np.log(prior[1:] / prior[:1]) if len(prior) == 2 else np.log(np.maximum(prior, 1e-300))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, spec) -> Forest:
    """Softmax boosting of `k` classes (one logistic series for two); y holds class numbers."""
    base = _base(np.bincount(y, weight, k) / weight.sum())
    raw, grower = np.tile(base, (len(x), 1)), _Grower(x, spec.leaves, spec.depth, spec.min_leaf_rows)
    hot = (y[:, None] == (np.arange(k)[None, :] if k > 2 else 1)).astype(float)
    trees, depths = [], []
    for _ in range(spec.steps()):
        p = _probabilities(raw)[:, -len(base) :]
        grad, hess = (p - hot) * weight[:, None], p * (1 - p) * weight[:, None]
        for s in range(len(base)):
            tree, deep, added = grower.tree(grad[:, s], hess[:, s], spec.learning_rate)
            trees.append(tree)
            depths.append(deep)
            raw[:, s] += added
    return Forest(base, *(np.stack(part) for part in zip(*trees)), np.array(depths, np.int32))


# --- fits of many tasks ---------------------------------------------------------------


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _nearest_ranks(n: int) -> np.ndarray:
    """Places, from 0, that `bin_edges` takes from `n` ordered values."""
    at = (n - 1) * np.linspace(0, 1, BINS)
    return np.rint(at).astype(np.int64)


def edges_of_all(rows: DataFrame, features: int, n: int) -> list[np.ndarray]:
    """`bin_edges` of each feature of `rows` (x), `n` in all, without bringing them together.

    A sketch only proposes cells; rows are counted per cell, and of cells with a wanted rank the values are ordered.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * features
        for b in batches:
            for f, column in enumerate(_matrix(b).T if b.num_rows else ()):
                if len(seen[f]) <= BINS:
                    seen[f] = np.unique(np.concatenate([seen[f], column]))[: BINS + 1]
        at = np.repeat(np.arange(features), [len(v) for v in seen])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.concatenate(seen))], ["f", "value"])

    values = rows.mapInArrow(few, "f int, value double").groupBy("f").agg(F.collect_set("value").alias("v"))
    found = {r["f"]: np.unique(r["v"]) for r in values.select("f", F.slice("v", 1, BINS + 1).alias("v")).collect()}
    many = [f for f in range(features) if len(found[f]) > BINS]
    if many:
        shares = np.linspace(0, 1, CELLS).tolist()
        sketch = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 20 * CELLS).alias(f"q{f}") for f in many]).first()
        cuts = {f: np.unique(sketch[f"q{f}"]) for f in many}

        def cells(column, f):  # even: between two cuts, odd: equal to a cut
            at = np.searchsorted(cuts[f], column)
            return 2 * at + (cuts[f][np.minimum(at, len(cuts[f]) - 1)] == column)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros(2 * len(cuts[f]) + 1, np.int64) for f in many}
            for b in batches:
                x = _matrix(b) if b.num_rows else np.empty((0, features))
                for f in many:
                    sums[f] += np.bincount(cells(x[:, f], f), minlength=len(sums[f]))
            for f in many:
                at = np.flatnonzero(sums[f])
                yield pa.record_batch([pa.array(np.full(len(at), f), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[f][at])], ["f", "cell", "n"])

        sums = {f: np.zeros(2 * len(cuts[f]) + 1, np.int64) for f in many}
        for r in rows.mapInArrow(counted, "f int, cell int, n long").groupBy("f", "cell").agg(F.sum("n").alias("n")).collect():
            sums[r["f"]][r["cell"]] = r["n"]
        wanted, open_cells = [], {}
        for f in many:
            ends, ranks = sums[f].cumsum(), _nearest_ranks(n)
            at = np.searchsorted(ends, ranks, side="right")
            found[f] = cuts[f][at[at % 2 == 1] // 2]
            open_cells[f] = np.unique(at[at % 2 == 0])
            wanted += [(f, int(c), [int(r) for r in ranks[at == c] - (ends[c] - sums[f][c])]) for c in open_cells[f]]

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b) if b.num_rows else np.empty((0, features))
                for f in many:
                    at = cells(x[:, f], f)
                    keep = np.isin(at, open_cells[f])
                    yield pa.record_batch(
                        [pa.array(np.full(keep.sum(), f), pa.int32()), pa.array(at[keep], pa.int32()), pa.array(x[keep, f])], ["f", "cell", "value"]
                    )

        if wanted:
            each = rows.mapInArrow(inside, "f int, cell int, value double").groupBy("f", "cell", "value").agg(F.count("*").alias("n"))
            asked = F.broadcast(rows.sparkSession.createDataFrame(wanted, "f int, cell int, ranks array<long>"))  # one row per cell
            running = F.sum("n").over(W.partitionBy("f", "cell").orderBy("value"))
            placed = each.withColumn("end", running).join(asked, ["f", "cell"])
            for r in placed.where("exists(ranks, r -> r < end AND r >= end - n)").select("f", "value").collect():
                found[r["f"]] = np.append(found[r["f"]], r["value"])
    distinct = [np.unique(found[f]) for f in range(features)]
    return [(d[:-1] + d[1:]) / 2 for d in distinct]


class _Team:
    """Tasks of a barrier stage that add up arrays through files of the shared folder.

    Each task adds up one share of all arrays, so what a task reads does not grow with their number. Tasks wait for
    files, as a barrier of Spark takes a second; a file is whole when it has its size.
    """

    def __init__(self, context: BarrierTaskContext, folder: str):
        self.context, self.rank, self.size, self.turn = context, context.partitionId(), len(context.getTaskInfos()), 0
        folder = re.sub("^file:/+", "/", f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}")  # a retry has its own
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.files.create_dir(self.folder)

    def _write(self, name: str, values: np.ndarray) -> None:
        with self.files.open_output_stream(f"{self.folder}/{name}-{self.rank}") as out:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B"))

    def _read(self, name: str, rank: int, size: int, start: int, end: int) -> np.ndarray:
        path = f"{self.folder}/{name}-{rank}"
        while self.files.get_file_info(path).size != 8 * size:
            time.sleep(WAIT)
        with self.files.open_input_file(path) as file:
            return np.frombuffer(file.read_at(8 * (end - start), 8 * start))

    def _drop(self, name: str) -> None:
        self.files.delete_file(f"{self.folder}/{name}-{self.rank}")

    def total(self, mine: np.ndarray) -> np.ndarray:
        """The sum of the arrays of all tasks."""
        if self.size == 1:
            return mine
        turn, self.turn = self.turn, self.turn + 1
        ends = [mine.size * i // self.size for i in range(self.size + 1)]
        share = ends[self.rank], ends[self.rank + 1]
        self._write(f"part-{turn}", mine)
        self._write(f"sum-{turn}", sum(self._read(f"part-{turn}", i, mine.size, *share) for i in range(self.size)))
        sizes = np.diff(ends).tolist()
        whole = np.concatenate([self._read(f"sum-{turn}", i, n, 0, n) for i, n in enumerate(sizes)])
        self._drop(f"part-{turn}")  # all have their sum of this turn, so they have read the parts, and the sums of the last turn
        if turn:
            self._drop(f"sum-{turn - 1}")
        return whole.reshape(mine.shape)

    def close(self) -> None:
        self.context.barrier()
        if not self.rank:
            self.files.delete_dir(self.folder)


def _array(shape: tuple[int, ...], kind) -> np.ndarray:
    """Zeros; a large array lies in a file without a name, so it never has to be in memory as a whole."""
    if math.prod(shape) * np.dtype(kind).itemsize < IN_MEMORY:
        return np.zeros(shape, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder) as file:
        return np.asarray(np.memmap(file, kind, "w+", shape=shape))


class _Leaf:
    """A node of a tree in the making: its rows in this task, the histogram of all tasks, and its children once known."""

    def __init__(self, rows: np.ndarray, h: np.ndarray, level: int, growth: _Growth):
        self.rows, self.h, self.level, self.kids = rows, h, level, None
        can = level < growth.depth and h[2, 0].sum() >= 2 * growth.least
        gain, self.feature, self.bin = best_split(h, growth.least) if can else (0.0, 0, 0)
        self.gain = gain if gain > 1e-10 else 0.0

    def ends(self) -> list[np.ndarray]:
        return [self.rows] if self.kids is None else [rows for kid in self.kids for rows in kid.ends()]


class _Growth:
    """One tree: splits are taken as `_Grower` takes them, leaves are looked at ahead so that few sums are needed."""

    def __init__(self, edges: list[np.ndarray], leaves: int, depth: int | None, least: int, rate: float):
        self.edges, self.leaves, self.depth, self.least, self.rate = edges, leaves, depth or leaves, least, rate
        size = 2 * leaves - 1
        self.feature, self.left = np.zeros(size, np.int32), np.arange(size, dtype=np.int32)
        self.right, self.cut, self.value = self.left.copy(), np.full(size, np.inf), np.zeros(size)
        self.deep, self.used, self.count, self.heap = 0, 1, 1, []

    def offer(self, node: int, leaf: _Leaf) -> None:
        heapq.heappush(self.heap, (-leaf.gain, node, leaf))

    def next(self) -> list[_Leaf]:
        """Takes all splits whose children are known; leaves to look at now, none if the tree is grown."""
        while self.count < self.leaves and self.heap[0][2].gain and self.heap[0][2].kids:
            _, node, leaf = heapq.heappop(self.heap)
            f, at = leaf.feature, self.used
            self.feature[node], self.cut[node], self.left[node], self.right[node] = f, self.edges[f][leaf.bin], at, at + 1
            self.deep, self.count, self.used = max(self.deep, leaf.level + 1), self.count + 1, at + 2
            for side, kid in enumerate(leaf.kids):
                self.offer(at + side, kid)
        if self.count == self.leaves or not self.heap[0][2].gain:
            return []
        unknown = [leaf for _, _, leaf in sorted(self.heap, key=lambda e: e[:2]) if leaf.gain and not leaf.kids]
        return unknown[: -(-(self.leaves - self.count) // 2)]

    def close(self, raw: np.ndarray):
        """Arrays of the grown tree and its depth; adds its values to the scores."""
        for _, node, leaf in self.heap:
            self.value[node] = -self.rate * leaf.h[0, 0].sum() / (leaf.h[1, 0].sum() + 1e-12)
            for rows in leaf.ends():
                raw[rows] += self.value[node]
        return (self.feature, self.cut, self.left, self.right, self.value), self.deep


def train_shared(codes: np.ndarray, y: np.ndarray, edges: list[np.ndarray], prior: np.ndarray, n: int, spec, team: _Team) -> Forest:
    """`train` on the rows of all tasks, `n` in all; `codes` (feature, row) are the bins of this task's rows."""
    base, mine, features = _base(prior), codes.shape[1], len(codes)
    series, first = len(base), len(prior) - len(base)
    raw, grad, hess = (_array((series, mine), np.float64) for _ in range(3))
    raw += base[:, None]
    everything = np.arange(mine, dtype=np.int32)
    unit = 2.0 ** (52 - n.bit_length())  # sums of n such multiples of at most 1 are exact

    parts = [slice(a, min(a + PART, mine)) for a in range(0, mine, PART)]
    counts = np.stack([np.bincount(c, minlength=BINS) for c in codes])

    def whole() -> np.ndarray:
        """Histograms of all rows, for every series."""
        out = np.zeros((series, 3, features, BINS))
        for f in range(features):
            for part in parts:
                code = codes[f, part].astype(np.intp)
                for s in range(series):
                    out[s, 0, f] += np.bincount(code, grad[s, part], BINS)
                    out[s, 1, f] += np.bincount(code, hess[s, part], BINS)
        out[:, 2] = counts
        return out

    def histogram(rows: np.ndarray, s: int, out: np.ndarray) -> None:
        for a in range(0, len(rows), PART):
            at = rows[a : a + PART]
            g, w = grad[s].take(at), hess[s].take(at)
            for f in range(features):
                code = codes[f].take(at).astype(np.intp)
                out[0, f] += np.bincount(code, g, BINS)
                out[1, f] += np.bincount(code, w, BINS)
                out[2, f] += np.bincount(code, minlength=BINS)

    def sums(asked: list[tuple[int, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(asked), 3, features, BINS))
        for (s, rows), part in zip(asked, out):
            histogram(rows, s, part)
        return team.total(out)

    trees, depths = [], []
    for _ in range(spec.steps()):
        for part in parts:
            p = _probabilities(raw[:, part].T)[:, -series:].T
            hot = y[part] == np.arange(first, len(prior))[:, None]
            grad[:, part] = np.rint((p - hot) * unit) / unit
            hess[:, part] = np.rint(p * (1 - p) * unit) / unit
        growths = [_Growth(edges, spec.leaves, spec.depth, spec.min_leaf_rows, spec.learning_rate) for _ in base]
        for growth, h in zip(growths, team.total(whole())):
            growth.offer(0, _Leaf(everything, h, 0, growth))
        while asked := [(s, leaf) for s, growth in enumerate(growths) for leaf in growth.next()]:
            sides, small = [], []
            for s, leaf in asked:
                goes = codes[leaf.feature].take(leaf.rows) <= leaf.bin
                sides.append((leaf.rows[goes], leaf.rows[~goes]))
                count = leaf.h[2, leaf.feature]
                small.append(int(count[leaf.bin + 1 :].sum() < count[: leaf.bin + 1].sum()))
            for (s, leaf), rows, less, h in zip(asked, sides, small, sums([(s, r[i]) for (s, _), r, i in zip(asked, sides, small)])):
                hists = (leaf.h - h, h) if less else (h, leaf.h - h)
                leaf.kids = [_Leaf(r, part, leaf.level + 1, growths[s]) for r, part in zip(rows, hists)]
                leaf.rows = None
        for s, growth in enumerate(growths):
            tree, deep = growth.close(raw[s])
            trees.append(tree)
            depths.append(deep)
    return Forest(base, *(np.stack(part) for part in zip(*trees)), np.array(depths, np.int32))


def tasks_at_once(spark: SparkSession) -> int:
    """Tasks that the cluster can run at once: a barrier stage must not have more."""
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _fit_by_tasks(rows: DataFrame, counts: np.ndarray, spec) -> Forest:
    """Forest for rows (x, y) in a barrier stage."""
    spark, n = rows.sparkSession, int(counts.sum())
    features = len(rows.first()["x"])
    edges, prior, folder = edges_of_all(rows, features, n), counts / n, scratch_path(spark, "forest")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                part = batch.slice(a, PART)
                codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, _matrix(part).T)]).astype(np.uint8)
                y = part.column("y").to_numpy().astype("<i4")
                yield pa.record_batch([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["codes", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team = _Team(BarrierTaskContext.get(), folder)
        codes, y = [np.empty((features, 0), np.uint8)], [np.empty(0, np.int32)]
        for batch in batches:
            for one, two in zip(batch.column("codes").to_pylist(), batch.column("y").to_pylist()):
                codes.append(np.frombuffer(one, np.uint8).reshape(features, -1))
                y.append(np.frombuffer(two, "<i4"))
        forest = train_shared(np.concatenate(codes, axis=1), np.concatenate(y), edges, prior, n, spec, team)
        team.close()
        if not team.rank:
            yield pa.record_batch([pa.array([forest.to_bytes()], pa.binary())], ["forest"])

    tasks = min(tasks_at_once(spark), -(-n // SHARE))
    dealt = rows.mapInArrow(pack, "codes binary, y binary").repartition(tasks)
    return Forest.from_bytes(bytes(dealt.mapInArrow(run, "forest binary", barrier=True).collect()[0]["forest"]))


def fit_forest(ready: DataFrame, labels: list[str], counts: dict[str, int], spec) -> Forest:
    """Forest for all rows (_features, _target); `counts` has the rows of each label."""
    labels = list(labels)
    number = F.array_position(F.lit(labels), F.col("_target")) - 1
    rows = ready.select(vector_to_array("_features").alias("x"), number.cast("int").alias("y"))
    if sum(counts.values()) > FIT_ROWS:
        return _fit_by_tasks(rows, np.array([counts[label] for label in labels]), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [b for b in batches if b.num_rows]
        x, y = np.concatenate([_matrix(b) for b in data]), np.concatenate([b.column("y").to_numpy() for b in data])
        order = np.lexsort((*x.T, y))  # sums do not depend on the order of arrival
        forest = train(x[order], y[order], np.ones(len(y)), len(labels), spec)
        yield pa.record_batch([pa.array([forest.to_bytes()], pa.binary())], ["forest"])

    return Forest.from_bytes(bytes(rows.repartition(1).mapInArrow(run, "forest binary").first()["forest"]))


def forest_probabilities(forest: Forest, features: Column) -> Column:
    """Class probabilities of a column of feature vectors."""

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = forest.scorer()
        for x in batches:
            yield pd.Series(list(_probabilities(raw(np.vstack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=object)

    return probabilities(vector_to_array(features))
