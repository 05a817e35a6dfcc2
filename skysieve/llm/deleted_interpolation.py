"""LM scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of two orders (pair and word, no trigram) and a uniform one:

    P(w | h) = a(b) c(h w) / c(h) + u(b) c(w) / N + z(b) / (V + 1),    b: the bucket of the context's frequency c(h)

and the weights of each bucket are learned by expectation-maximisation on held-out counts: one fold of the training
documents is left out of the counts for that, the scores use the counts of all of them.

Counts are exchanged in packed form. A task reads documents into batches of about a million tokens and finds the
distinct words and pairs of each batch; their 64-bit hashes, with the batch's counts, go to buckets of the hash
space as sorted slices, one row per batch and bucket. So a key leaves a batch once however frequent it is, no bucket
is hot, and a bucket's content depends on the hash alone. A bucket adds up its slices and answers each batch with
the totals, slice by slice in the same order. The batch then scores its documents. All tables between these steps
lie in the shared folder.

Tokens are words (A-Z lowered) and one end per text. Hashes of words are 64 bits wide (a hundred million distinct
words hold 0.0003 pairs that share a count), those of pairs 40 bits within a bucket of half a million keys: about one pair in two
million shares its count with another, at any size of the corpus. Nulls and odd input: a null text counts as empty
and is one end. Without training documents (N = 0) every token has probability 1 / (V + 1) = 1. Rows that repeat
an id are scored and counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.shared import fold, remove, slices, utf8
from skysieve.session import materialise, scratch_path

#: Tokens of a batch; keys that a bucket gets on average; buckets of context frequency (by powers of two).
BATCH_TOKENS, BUCKET_KEYS, FREQUENCIES = 1_000_000, 500_000, 24
#: Rounds of EM, and the gain in mean log-likelihood (nats per token) below which it stops.
ROUNDS, LEAST_GAIN = 20, 1e-5
SEED = np.uint64(0x9E3779B97F4A7C15)
#: The bits that tell pairs apart within a bucket; words have all 64.
LOW = np.uint64((1 << 40) - 1)
#: Batches of held-out documents have a name of their own; only they need the counts without themselves.
HELD, TAUGHT = "held-", "all-"
BATCH = "kind int, batch string, bucket int, keys binary, train binary, kept binary, body binary"
BATCH_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("batch", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()),
        ("train", pa.binary()), ("kept", pa.binary()), ("body", pa.binary()),
    ]
)
ANSWER = "kind int, batch string, bucket int, train binary, kept binary, types long, total long, kept_types long, kept_total long"
ANSWER_ARROW = pa.schema(
    [("kind", pa.int32()), ("batch", pa.string()), ("bucket", pa.int32()), ("train", pa.binary()), ("kept", pa.binary())]
    + [(n, pa.int64()) for n in ("types", "total", "kept_types", "kept_total")]
)
WORDS, PAIRS, BODY = 1, 2, 0


def planes(values: np.ndarray) -> bytes:
    """Numbers compressed by byte: the first bytes of all before the second ones, so equal bytes meet."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (first >> np.uint64(31))) * SEED + second
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the 16 high bits, in the order of the hash."""
    return ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def keys_of(kind: int, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash and its key there; slices are in the order of both."""
    bucket = bucket_of(h, buckets)
    return bucket, h if kind == WORDS else h & LOW


class Batch:
    """Documents as numbers of the batch's words; word 0 is the end and stands before the first word too."""

    def __init__(self):
        self.place: dict[bytes, int] = {b"": 0}
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, part: int, text: bytes) -> None:
        place = self.place
        numbers = [place.setdefault(w, len(place)) for w in text.lower().split()]
        numbers.append(0)
        self.tokens.append(np.array(numbers, np.int32))
        self.docs.append((doc_id, part))
        self.size += len(numbers)

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, 11) for w in self.place], np.uint64)


def pair_codes(tokens: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Of each token, its predecessor (the end before the first) and itself, as one number."""
    before = np.roll(tokens, 1)
    before[starts] = 0
    return before.astype(np.int64) * words + tokens


def _slices_of(kind: int, batch: str, h: np.ndarray, train: np.ndarray, kept: np.ndarray, buckets: int) -> Iterator[tuple]:
    place, keys = keys_of(kind, h, buckets)
    order = np.lexsort((keys, place))
    place, keys, train, kept = place[order], keys[order], train[order], kept[order]
    edges = np.searchsorted(place, np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[bucket], edges[bucket + 1])
        gaps = np.diff(keys[mine], prepend=np.uint64(0))
        yield kind, batch, int(bucket), planes(gaps), planes(train[mine]), planes(kept[mine]), None


def _pack(batch: Batch, name: str, word_buckets: int, pair_buckets: int) -> Iterator[tuple]:
    tokens = np.concatenate(batch.tokens)
    sizes = np.array([len(t) for t in batch.tokens], np.int32)
    parts = np.array([p for _, p in batch.docs], np.int8)
    train, kept = (np.repeat(parts >= least, sizes) for least in (1, 2))
    h = batch.hashes()
    counts = [np.bincount(tokens[m], minlength=len(h)).astype(np.uint32) for m in (train, kept)]
    yield from _slices_of(WORDS, name, h, *counts, word_buckets)
    starts = np.cumsum(sizes) - sizes
    pairs, at = np.unique(pair_codes(tokens, starts, len(h)), return_inverse=True)
    counts = [np.bincount(at[m], minlength=len(pairs)).astype(np.uint32) for m in (train, kept)]
    yield from _slices_of(PAIRS, name, pair_hash(h[pairs // len(h)], h[pairs % len(h)]), *counts, pair_buckets)
    ids = pa.array([d for d, _ in batch.docs], pa.int64())
    body = pa.table(
        {
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "parts": [parts.tobytes()], "sizes": [sizes.tobytes()],
            "tokens": [planes(tokens)], "hashes": [planes(h)],
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema) as writer:
        writer.write_table(body)
    yield BODY, name, -1, None, None, None, sink.getvalue().to_pybytes()


def _read_batches(word_buckets: int, pair_buckets: int, batch_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_batches = TaskContext.get().partitionId(), 0, {HELD: Batch(), TAUGHT: Batch()}

        def flush(kind: str) -> Iterator[pa.RecordBatch]:
            rows = list(_pack(open_batches[kind], f"{kind}{task}-{made}", word_buckets, pair_buckets))
            open_batches[kind] = Batch()
            for a in range(0, len(rows), 64):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 64]), BATCH_ARROW)]
                yield pa.record_batch(columns, schema=BATCH_ARROW)

        for part in slices(batches, 64):
            for doc_id, number, text in zip(part.column("doc_id").to_pylist(), part.column("part").to_pylist(), utf8(part, "text")):
                kind = HELD if number == 1 else TAUGHT
                open_batches[kind].add(doc_id, number, text)
                if open_batches[kind].size >= batch_tokens:
                    yield from flush(kind)
                    made += 1
        for kind, batch in open_batches.items():
            if batch.size:
                yield from flush(kind)

    return run


def _blobs(rows: pa.Table, name: str) -> Iterator[bytes]:
    for chunk in rows.column(name).iterchunks():
        for value in chunk:
            yield value.as_py()


def _add_up(rows: pa.Table) -> pa.Table:
    """One bucket: the totals of its keys, for each batch in the order of its slice."""
    kinds, names, buckets = (rows.column(c).to_pylist() for c in ("kind", "batch", "bucket"))
    keys = [np.cumsum(unplanes(k, np.uint64), dtype=np.uint64) for k in _blobs(rows, "keys")]
    edges = np.cumsum([0] + [len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    totals = []
    for column in ("train", "kept"):
        counts = np.concatenate([unplanes(c, np.uint32) for c in _blobs(rows, column)])
        totals.append(np.bincount(at, counts, len(distinct)).astype(np.int64))
    facts = [f for t in totals for f in (int((t > 0).sum()), int(t.sum()))]
    out = [(kinds[0], None, buckets[0], None, None, *facts)]
    for i, name in enumerate(names):
        mine = at[edges[i] : edges[i + 1]]
        # the upper bytes are mostly zeros and vanish when they are compressed
        answer = [planes(t[mine].astype(np.uint64)) for t in totals[: 2 if name.startswith(HELD) else 1]]
        out.append((kinds[0], name, buckets[0], *answer, *[None] * (2 - len(answer)), 0, 0, 0, 0))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWER_ARROW)], schema=ANSWER_ARROW)


class Counted:
    """A batch with the totals of its words and pairs."""

    def __init__(self, body: bytes, answers: pa.Table, word_buckets: int, pair_buckets: int):
        table = pa.ipc.open_stream(body).read_all()
        self.ids = table.column("ids")[0].as_py()
        blob = {c: table.column(c)[0].as_py() for c in table.column_names if c != "ids"}
        self.parts, self.sizes = np.frombuffer(blob["parts"], np.int8), np.frombuffer(blob["sizes"], np.int32)
        self.tokens, self.h = unplanes(blob["tokens"], np.int32), unplanes(blob["hashes"], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pairs, self.at = np.unique(pair_codes(self.tokens, self.starts, len(self.h)), return_inverse=True)
        n = len(self.h)
        pair_h = pair_hash(self.h[self.pairs // n], self.h[self.pairs % n])
        order = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = np.array(order.column("kind").to_pylist())
        self.totals = {}
        for column in ("train", "kept"):
            parts = [b if b is None else unplanes(b, np.uint64) for b in _blobs(order, column)]
            if any(p is None for p in parts):
                continue
            for kind, h, buckets in ((WORDS, self.h, word_buckets), (PAIRS, pair_h, pair_buckets)):
                found = np.empty(len(h), np.int64)
                place, keys = keys_of(kind, h, buckets)
                found[np.lexsort((keys, place))] = np.concatenate([p for p, k in zip(parts, kinds) if k == kind])
                self.totals[column, kind] = found

    def estimates(self, column: str, facts: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of each token: frequency bucket of its context, pair, word and uniform estimate."""
        words, pairs = self.totals[column, WORDS], self.totals[column, PAIRS]
        context = words[self.pairs // len(self.h)]
        bucket = np.minimum(np.frexp(context.astype(float))[1], FREQUENCIES - 1)
        high = pairs / np.maximum(1, context)
        total, types = facts[column]
        low = words[self.tokens] / max(1, total)
        return bucket[self.at], high[self.at], low, 1 / (types + 1)


def _grouped(word_buckets: int, pair_buckets: int, use):
    """A group function: the body and the answers of one batch."""

    def run(rows: pa.Table) -> pa.Table:
        kind = np.array(rows.column("kind").to_pylist())
        body = rows.column("body").filter(pa.array(kind == BODY))[0].as_py()
        answers = rows.filter(pa.array(kind != BODY)).drop_columns(["body"])
        return use(Counted(body, answers, word_buckets, pair_buckets))

    return run


def _held_out(facts: dict):
    """Estimates of the tokens of held-out documents, under the counts without them."""

    def use(batch: Counted) -> pa.Table:
        bucket, high, low, _ = batch.estimates("kept", facts)
        columns = [bucket.astype(np.int8).tobytes(), high.astype("<f8").tobytes(), low.astype("<f8").tobytes()]
        return pa.table([pa.array([c], pa.binary()) for c in columns], ["bucket", "high", "low"])

    return use


def _posterior(weights: np.ndarray, uniform: float):
    """Expected use of each estimate per bucket, and the log-likelihood, of the held-out tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, loss = np.zeros((FREQUENCIES, 3)), np.zeros(FREQUENCIES)
        for batch in batches:
            for b, high, low in zip(*(batch.column(c).to_pylist() for c in ("bucket", "high", "low"))):
                b, high, low = np.frombuffer(b, np.int8), np.frombuffer(high, "<f8"), np.frombuffer(low, "<f8")
                parts = weights[b] * np.stack([high, low, np.full(len(b), uniform)], axis=1)
                p = parts.sum(axis=1)
                parts /= p[:, None]
                for i in range(3):
                    use[:, i] += np.bincount(b, parts[:, i], FREQUENCIES)
                loss += np.bincount(b, np.log(p), FREQUENCIES)
        columns = [pa.array(np.arange(FREQUENCIES), pa.int32()), *[pa.array(use[:, i]) for i in range(3)], pa.array(loss)]
        yield pa.record_batch(columns, ["b", "high", "low", "uniform", "loss"])

    return run


def learn_weights(held: DataFrame, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, word, uniform) per frequency bucket; a bucket without held-out tokens keeps thirds."""
    weights, last = np.full((FREQUENCIES, 3), 1 / 3), -math.inf
    for _ in range(rounds):
        sums = held.mapInArrow(_posterior(weights, uniform), "b int, high double, low double, uniform double, loss double")
        rows = sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("high", "low", "uniform", "loss")]).collect()
        use, loss = np.zeros((FREQUENCIES, 3)), 0.0
        for r in rows:
            use[r["b"]] = r["high"], r["low"], r["uniform"]
            loss += r["loss"]
        n = use.sum(axis=1, keepdims=True)
        weights = np.where(n > 0, use / np.maximum(n, 1e-300), weights)
        # nothing seen may become impossible
        weights = np.maximum(weights, 1e-9)
        weights /= weights.sum(axis=1, keepdims=True)
        if not n.sum() or (loss - last) / n.sum() < LEAST_GAIN:
            break
        last = loss
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, facts: dict):
    def use(batch: Counted) -> pa.Table:
        bucket, high, low, uniform = batch.estimates("train", facts)
        total, types = facts["train"]
        # a context that was never seen says nothing: its share goes to the other two
        mix = weights[bucket]
        unseen = bucket == 0
        mix[unseen, 0] = 0
        mix[unseen] /= mix[unseen].sum(axis=1, keepdims=True)
        p = mix[:, 0] * high + mix[:, 1] * low + mix[:, 2] * uniform
        count = batch.totals["train", WORDS][batch.tokens]
        base = np.log10((count + 0.1) / (total + 0.1 * (types + 1)))
        add = lambda x: np.add.reduceat(x, batch.starts)
        columns = [
            pa.array(batch.ids, pa.int64()), pa.array(batch.parts == 0), pa.array(batch.sizes.astype(np.int64)),
            pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(batch.ids), total, np.int64)),
            pa.array(add(base)), pa.array(add(np.log10(p))),
        ]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return use


def interpolated_scores(
    documents: DataFrame, folds: int = 10, doc_id: str = "doc_id", text: str = "text",
    batch_tokens: int = BATCH_TOKENS, bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Documents of fold 0 teach nothing; those of fold 1 are the held-out counts of the weights.
    """
    spark = documents.sparkSession
    part = F.least(fold(doc_id, folds), F.lit(2))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), part.alias("part"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not size[1]:
        return spark.createDataFrame([], SCORED)
    tokens = size[0] // 6 + size[1]  # only sets the number of buckets
    word_buckets, pair_buckets = (min(1 << 16, 1 + n // bucket_keys) for n in (tokens // 4, tokens))
    path = packed_path = scratch_path(spark, "lm-batches")
    packed = docs.mapInArrow(_read_batches(word_buckets, pair_buckets, batch_tokens), BATCH)
    packed.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    packed = spark.read.schema(BATCH).parquet(path)
    keyed = packed.where(F.col("kind") != BODY).drop("body")
    path = scratch_path(spark, "lm-answers")
    keyed.groupBy("kind", "bucket").applyInArrow(_add_up, ANSWER).write.option("compression", "zstd").parquet(path)
    answers = spark.read.schema(ANSWER).parquet(path)
    sums = ("types", "total", "kept_types", "kept_total")
    found = answers.where(F.col("batch").isNull() & (F.col("kind") == WORDS)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in sums]).first()
    facts = {"train": (found[1], found[0]), "kept": (found[3], found[2])}
    bodies = spark.read.schema(BATCH).parquet(f"{packed_path}/kind={BODY}").select(
        F.lit(BODY).alias("kind"), "batch", "bucket", F.lit(None).cast("binary").alias("train"), F.lit(None).cast("binary").alias("kept"), "body"
    )
    replies = answers.where(F.col("batch").isNotNull()).select("kind", "batch", "bucket", "train", "kept", F.lit(None).cast("binary").alias("body"))
    rows = bodies.unionAll(replies)
    remove(spark, *[f"{packed_path}/kind={kind}" for kind in (WORDS, PAIRS)])
    held = rows.where(F.col("batch").startswith(HELD)).groupBy("batch").applyInArrow(_grouped(word_buckets, pair_buckets, _held_out(facts)), "bucket binary, high binary, low binary")
    held = materialise(held, "lm-held-out")
    weights = learn_weights(held, 1 / (facts["kept"][1] + 1))
    return rows.groupBy("batch").applyInArrow(_grouped(word_buckets, pair_buckets, _score(weights, facts)), SCORED)
