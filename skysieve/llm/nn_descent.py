"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Build. Every row gets a first list of `k` neighbours: rows are sorted by the signs of random projections, cut into runs
of `leaf` rows, and each run is compared within itself; `trees` such orders are merged. Then rounds of NN-descent: every
row (the pivot) meets its neighbours and the rows it is a neighbour of, joins tell each of them about the others, and a
pair whose score beats the worst in one of its lists is a candidate for that list. Pairs that met in an earlier round
are left out (both ends old). Rounds end when fewer than `least` of all places change, or after `rounds`.
A row that many lists hold lends itself to about `k` of them, drawn by a hash; so no pivot's group grows with the data.

Search. The row of the index for a node holds the codes of its neighbours, so one join brings a query to all of them.
Every query starts at its own node and keeps the `beam` best nodes it has seen; each round expands all of these that
have not been expanded. It ends when no query has one left. The `refine` best are then scored on the original vectors.

Codes are vectors of bytes with one scale per vector; lists and beams use them, results never do. Every row is indexed.
Recall is what a beam of this width finds, see README; a wider beam finds more.

Nulls and odd input: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
with a null id. Vectors of different lengths are compared on their common components; very long ones make larger codes,
nothing else. Rows that repeat an id are rows of their own; of repeated query rows the first by vector is asked, and
only its own row is no candidate. Ties go to the smaller id. With fewer rows than asked for all are returned. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skysieve.session import materialise

SEED = 42
#: Neighbours of a node; rows compared within a first run; first orders; rounds at most; share of places that still change.
K, LEAF, TREES, ROUNDS, LEAST = 24, 512, 3, 6, 0.01
#: Nodes that a query keeps; of these scored on original vectors; rounds of a search at most.
BEAM, REFINE, STEPS = 256, 80, 64
#: Bits of a projection's order.
BITS = 40
CODES = "node long, vec_id long, asks boolean, code binary"
PAIRS = "a long, b long, score float"


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def encode(rows: list[list[float]], width: int, unit: float) -> list[bytes]:
    """Per vector its scale (a double) and one signed byte per component, zeros up to the width.

    `unit` is the largest component of all, so that codes stay in the range of single floats.
    """
    out = []
    for row in rows:
        x = np.zeros(width)
        x[: len(row)] = row
        x /= unit
        scale = float(np.abs(x).max()) / 127
        codes = np.rint(x / scale) if scale > 0 and math.isfinite(1 / scale) else np.sign(x)
        out.append(np.float64(scale).tobytes() + codes.astype(np.int8).tobytes())
    return out


def decode(codes: list[bytes] | np.ndarray, width: int) -> np.ndarray:
    """The vectors that codes stand for, as single floats: what lists and beams compare."""
    flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 8 + width)
    scale = flat[:, :8].copy().view(np.float64)
    return (flat[:, 8:].view(np.int8) * scale).astype(np.float32)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """The rows of sorted batches as tables that never cut a group of equal keys, of `least` rows or more."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))


def _pairs(a, b, score) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float32())], ["a", "b", "score"])


def _points(vectors: DataFrame, is_query: Column, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part, written once: node (a number of its own), vec_id, asks, vector, code; and the width of codes."""
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("node"),
    )
    rows = materialise(rows, "knn-rows")
    largest = F.max(F.array_max(F.transform("vector", F.abs)))
    width, unit = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(largest, F.lit(1.0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array(encode(batch.column("vector").to_pylist(), width, unit), pa.binary())
            yield pa.record_batch([*batch.columns, codes], [*batch.schema.names, "code"])

    schema = "node long, vec_id long, asks boolean, vector array<double>, code binary"
    points = rows.select("node", "vec_id", "asks", "vector").mapInArrow(run, schema)
    return materialise(points, "knn-points"), width


def _centre(points: DataFrame, width: int, total: int) -> np.ndarray:
    """Mean of all decoded vectors; tasks add up, one row each comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += decode(batch.column("code").to_pylist(), width).sum(axis=0, dtype=np.float64)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(total)], ["i", "x"])

    sums = points.select("code").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
    return np.array([r["x"] for r in sums.collect()]) / total  # one number per component


def first_pairs(points: DataFrame, width: int, total: int, k: int, leaf: int, trees: int, seed: int) -> DataFrame:
    """PAIRS of rows that lie in one run of an order by projections, the best `k` of each row and order."""
    centre = _centre(points, width, total)
    planes = np.random.default_rng(seed).standard_normal((trees, width, BITS)).astype(np.float32)
    powers = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = decode(batch.column("code").to_pylist(), width) - centre.astype(np.float32)
                for tree in range(trees):
                    place = ((x @ planes[tree]) > 0) @ powers
                    columns = [pa.array(np.full(len(x), tree)), pa.array(place), *(batch.column(c) for c in ("node", "code"))]
                    yield pa.record_batch(columns, ["tree", "place", "node", "code"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            x, nodes, tree = decode(rows.column("code").to_pylist(), width), *(rows.column(c).to_numpy() for c in ("node", "tree"))
            score = x @ x.T
            # a run may go over the end of an order: rows of two orders can be one row twice
            score[nodes[:, None] == nodes[None, :]] = -np.inf
            take = min(k, len(nodes) - 1)
            if take > 0:
                at = np.argpartition(-score, take - 1, axis=1)[:, :take]
                value = np.take_along_axis(score, at, 1).ravel()
                ok = np.isfinite(value)
                yield _pairs(np.repeat(nodes, take)[ok], nodes[at].ravel()[ok], value[ok])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 2 * leaf:
                continue
            rows = pa.Table.from_batches(held)
            while n >= 2 * leaf:
                yield from best(rows.slice(0, leaf))
                rows, n = rows.slice(leaf), n - leaf
            held = rows.to_batches()
        if n:
            rows = pa.Table.from_batches(held)
            for part in (rows.slice(0, (n + 1) // 2), rows.slice((n + 1) // 2)) if n > leaf else (rows,):
                yield from best(part)

    # equal places are told apart by a hash, so a crowd of equal rows is cut like any other run
    keyed = points.select("node", "code").mapInArrow(orders, "tree long, place long, node long, code binary")
    key = ["tree", "place", F.xxhash64("node", F.lit(seed))]
    return keyed.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(runs, PAIRS)


def best_lists(old: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
    """The `k` best neighbours (a, b, score, fresh) of each row; fresh: not in its old list."""
    rows = found.select("a", "b", "score", F.lit(True).alias("fresh"))
    if old is not None:
        rows = rows.unionAll(old.select("a", "b", "score", F.lit(False)))
    one = rows.repartition("a").groupBy("a", "b").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    # ties by a hash: a crowd of equal rows then links at random, instead of all to the same few
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), F.xxhash64("a", "b"), "b"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def meetings(lists: DataFrame, k: int, seed: int) -> DataFrame:
    """Who meets at whom: (pivot, member, fresh), from lists both ways.

    A row that more than `k` lists hold is lent to each with probability k / lists.
    """
    held = lists.groupBy("b").agg(F.count("*").alias("held"))
    draw = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 30)) * F.col("held") < F.lit(k << 30)
    back = lists.join(held, "b").where(draw).select(F.col("b").alias("pivot"), F.col("a").alias("member"), "fresh")
    both = lists.select(F.col("a").alias("pivot"), F.col("b").alias("member"), "fresh").unionAll(back)
    return both.groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))


#: Rows of meetings that one pass over padded groups takes.
MET = 1 << 13


def _local_join(width: int):
    """All pairs of the members of each pivot, where one is fresh and the score beats the worst of the first's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "pivot", MET):
            pivots, nodes = rows.column("pivot").to_numpy(), rows.column("member").to_numpy()
            fresh = np.array(rows.column("fresh").to_pylist(), bool)
            worst, x = rows.column("worst").to_numpy(), decode(rows.column("code").to_pylist(), width)
            starts = _starts(pivots)
            sizes = np.diff(np.append(starts, len(pivots)))
            # groups of like size together, so that little is padded
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                most = int(sizes[order[at]] * 5 // 4 + 4)
                stop = at + int(np.searchsorted(sizes[order[at:]], most, side="right"))
                stop = min(stop, at + max(1, (1 << 22) // (most * most)))
                groups = order[at:stop]
                wide = int(sizes[groups].max())
                place = starts[groups][:, None] + np.arange(wide)
                there = np.arange(wide) < sizes[groups][:, None]
                place = np.where(there, place, 0)
                y = x[place]
                score = y @ y.transpose(0, 2, 1)
                some = fresh[place]
                good = score > worst[place][:, :, None]
                good &= some[:, :, None] | some[:, None, :]
                good &= there[:, :, None] & there[:, None, :]
                good &= ~np.eye(wide, dtype=bool)
                g, i, j = np.nonzero(good)
                if len(g):
                    yield _pairs(nodes[place[g, i]], nodes[place[g, j]], score[g, i, j])
                at = stop

    return run


def neighbour_graph(
    points: DataFrame, width: int, k: int = K, leaf: int = LEAF, trees: int = TREES, rounds: int = ROUNDS,
    least: float = LEAST, seed: int = SEED,
) -> DataFrame:
    """(a, b, score, fresh): the neighbours of each node of `points` (node, code) after NN-descent."""
    if trees < 2:
        raise ValueError("two orders or more are needed: the runs of one order have no links between them")
    total = points.count()
    lists = materialise(best_lists(None, first_pairs(points, width, total, k, leaf, trees, seed), k), "knn-lists")
    for turn in range(rounds):
        worst = lists.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
        facts = points.select("node", "code").join(worst, "node", "left")
        facts = facts.select(F.col("node").alias("member"), "code", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        met = materialise(meetings(lists, k, seed + turn), "knn-meetings")
        coded = met.join(facts, "member").repartition("pivot").sortWithinPartitions("pivot", "member")
        lists = materialise(best_lists(lists, coded.mapInArrow(_local_join(width), PAIRS), k), "knn-lists")
        if lists.agg(F.count_if("fresh")).first()[0] <= least * k * total:
            break
    return lists


def search_index(lists: DataFrame, points: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Per node: node, near (its neighbours' numbers, 8 bytes each), codes (their codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "pivot", MET):
            pivots, nodes, codes = rows.column("pivot").to_numpy(), rows.column("member").to_numpy(), rows.column("code").to_pylist()
            starts = _starts(pivots)
            cuts = list(zip(starts, np.append(starts[1:], len(pivots))))
            near = [nodes[a:b].tobytes() for a, b in cuts]
            yield pa.record_batch(
                [pa.array(pivots[starts]), pa.array(near, pa.binary()), pa.array([b"".join(codes[a:b]) for a, b in cuts], pa.binary())],
                ["node", "near", "codes"],
            )

    facts = points.select(F.col("node").alias("member"), "code")
    rows = meetings(lists, k, seed).join(facts, "member").repartition("pivot").sortWithinPartitions("pivot", "member")
    return materialise(rows.mapInArrow(run, "node long, near binary, codes binary"), "knn-index")


STATE = "query long, code binary, nodes binary, scores binary, done binary, left int"


def _frontier(beam: int):
    """One row per node to expand: node, query, code, worst (the least score of a full beam)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for query, code, nodes, scores, done in zip(*(batch.column(c).to_pylist() for c in ("query", "code", "nodes", "scores", "done"))):
                nodes, scores = np.frombuffer(nodes, np.int64), np.frombuffer(scores, np.float32)
                todo = nodes[~np.frombuffer(done, bool)]
                worst = scores.min() if len(scores) >= beam else -np.inf
                for column, value in zip(out, (todo, np.full(len(todo), query), [code] * len(todo), np.full(len(todo), worst, np.float32))):
                    column.append(value)
            flat = [np.concatenate(out[i]) if out[i] else [] for i in (0, 1, 3)]
            codes = pa.array([c for part in out[2] for c in part], pa.binary())
            yield pa.record_batch(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), codes, pa.array(flat[2], pa.float32())],
                ["node", "query", "code", "worst"],
            )

    return run


def _expand(width: int):
    """Per row of the frontier, met with its node's index row: the neighbours that beat the query's worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, nodes, scores = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("query", "code", "worst", "near", "codes"))
            for query, code, worst, near, codes in zip(*columns):
                score = decode([codes], width) @ decode([code], width)[0]
                good = score > worst
                if good.any():
                    queries.append(query)
                    nodes.append(np.frombuffer(near, np.int64)[good].tobytes())
                    scores.append(score[good].tobytes())
            if queries:
                yield pa.record_batch(
                    [pa.array(queries, pa.int64()), pa.array(nodes, pa.binary()), pa.array(scores, pa.binary())],
                    ["query", "nodes", "scores"],
                )

    return run


def _merge(beam: int):
    """Rows sorted by query, its state first, then what its expansions found: the next state."""

    def sent(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        names = [f.split()[0] for f in STATE.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def merged(query, code, nodes: list, scores: list) -> tuple:
        # the first part is the state, all of which has been expanded by now
        old = len(nodes[0]) // 8
        node, score = np.frombuffer(b"".join(nodes), np.int64), np.frombuffer(b"".join(scores), np.float32)
        node, first = np.unique(node, return_index=True)  # the first of equals: the state's before those found again
        score, done = score[first], first < old
        best = np.lexsort((node, -score))[:beam]
        return query, code, node[best].tobytes(), score[best].tobytes(), done[best].tobytes(), int((~done[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, code, nodes, scores, out = None, None, [], [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("query", "code", "nodes", "scores"))
            for query, its, found, value in zip(*columns):
                if query != current:
                    if current is not None:
                        out.append(merged(current, code, nodes, scores))
                    current, code, nodes, scores = query, its, [], []
                nodes.append(found)
                scores.append(value)
            if len(out) >= 256:
                yield sent(out)
                out = []
        if current is not None:
            out.append(merged(current, code, nodes, scores))
        if out:
            yield sent(out)

    return run


def greedy_search(index: DataFrame, starts: DataFrame, width: int, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(query, node, score): the beam of each query of `starts` (query, code), a node of the index that it starts at."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            nodes = [int(q).to_bytes(8, "little", signed=True) for q in batch.column("query").to_pylist()]
            # its own node is above all others, so it never leaves the beam
            columns = [nodes, [np.float32(np.inf).tobytes()] * n, [b"\0"] * n]
            arrays = [batch.column("query"), batch.column("code"), *(pa.array(c, pa.binary()) for c in columns), pa.array([1] * n, pa.int32())]
            yield pa.record_batch(arrays, [f.split()[0] for f in STATE.split(", ")])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, scores = (batch.column(c).to_pylist() for c in ("nodes", "scores"))
            queries = np.repeat(batch.column("query").to_numpy(), [len(n) // 8 for n in nodes])
            yield pa.record_batch(
                [pa.array(queries, pa.int64()), pa.array(np.frombuffer(b"".join(nodes), np.int64)), pa.array(np.frombuffer(b"".join(scores), np.float32))],
                ["query", "node", "score"],
            )

    state = materialise(starts.select("query", "code").mapInArrow(begin, STATE), "knn-state")
    for _ in range(steps):
        rows = state.where(F.col("left") > 0).select("query", "code", "nodes", "scores", "done")
        frontier = rows.mapInArrow(_frontier(beam + 1), "node long, query long, code binary, worst float")
        met = frontier.join(index, "node").select("query", "code", "worst", "near", "codes")
        found = met.mapInArrow(_expand(width), "query long, nodes binary, scores binary")
        both = state.select("query", F.lit(0).alias("later"), "code", "nodes", "scores").unionAll(
            found.select("query", F.lit(1), F.lit(None).cast("binary"), "nodes", "scores")
        )
        both = both.repartition("query").sortWithinPartitions("query", "later")
        state = materialise(both.mapInArrow(_merge(beam + 1), STATE), "knn-state")
        if state.where(F.col("left") > 0).isEmpty():
            break
    return state.select("query", "nodes", "scores").mapInArrow(end, "query long, node long, score float")


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, n: int = 20, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
    leaf: int = LEAF, trees: int = TREES, rounds: int = ROUNDS, beam: int = BEAM, refine: int = REFINE, seed: int = SEED,
) -> DataFrame:
    """Per query the nearest other rows found: query_id, rank (from 1), vec_id, score (inner product in double)."""
    points, width = _points(vectors, is_query, vec_id, vector)
    lists = neighbour_graph(points, width, k, leaf, trees, rounds, seed=seed)
    index = search_index(lists, points, k, seed)
    asked = points.where("asks").groupBy("vec_id").agg(F.min(F.struct("vector", "node", "code")).alias("one"))
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), F.col("one.node").alias("query"), "one.vector", "one.code"), "knn-asked")
    found = greedy_search(index, asked, width, max(beam, n), STEPS).where("query <> node")
    rough = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))
    found = found.withColumn("rough", rough).where(F.col("rough") <= max(refine, n)).select("query", "node")
    theirs = points.select("node", "vec_id", F.col("vector").alias("other"))
    pairs = found.join(theirs, "node").join(asked.select("query", "query_id", "vector"), "query")
    product = F.aggregate(F.zip_with("vector", "other", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", product.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
