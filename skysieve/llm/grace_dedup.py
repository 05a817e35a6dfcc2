"""Exact dedup: Grace hash deduplication.

Every level does the same. Each task first merges the records it reads in an open-addressing table that compares
complete content, so a text that fills a third of the corpus leaves a task as one record. The merged records go
to a spill table in the shared folder, each with the bucket of its content's hash at this level. Buckets that fit
are deduplicated, one bucket a task, in such a table again; records of buckets that don't fit go through the next
level, which hashes anew. The keeper and the size of each group then go back to the members from level to level,
by joins on record numbers that occur once on either side. Everything between the levels lies in the shared
folder, so lost executors cost only their running tasks.

Nulls and odd input: a null text counts as empty; texts are equal when identical after replacing each run of ASCII
white space by one space. Of equal texts the smallest doc_id stays (null ids come last; if all are null, null is
the keeper). Rows that repeat an id are rows of their own and counted; of rows that share the keeper's id all are
marked as kept. An empty table gives an empty result. Only the id and the text are read, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.shared import only_rows, slices, utf8
from skysieve.session import materialise, scratch_path

#: Bytes of content that a bucket gets on average; that a table in memory may hold; levels of spilling at most.
BUCKET_BYTES, TABLE_BYTES, LEVELS = 2 << 20, 24 << 20, 6

SPILL = pa.schema(
    [
        ("record", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("keep", pa.int64()), ("bytes", pa.int64()),
        ("content", pa.binary()), ("members", pa.list_(pa.int64())),
    ]
)
MERGED = "record long, keep long, group_size long, sha string"
MERGED_ARROW = pa.schema([("record", pa.int64()), ("keep", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])
SPACES = b" \t\n\r\v\f"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return b" " * (text[0] in SPACES) + inner + b" " * (text[-1] in SPACES)


class ContentTable:
    """Open addressing with linear probing; a slot matches if the complete content is equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, content: bytes) -> int:
        """The number of the content's entry, which is new if it is the last."""
        mask, hashed = len(self.slots) - 1, xxhash.xxh3_64_intdigest(content)
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.bytes += len(content) + 150
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _spiller(level: int, buckets: int, from_rows: bool, table_bytes: int):
    """Merges what a task reads and gives each merged record a number and a bucket."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 33)

        def flush(table: ContentTable, groups: list[list]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(groups), 2000):
                part, texts = groups[a : a + 2000], table.contents[a : a + 2000]
                buckets_of = [xxhash.xxh64_intdigest(c, seed=level) % buckets for c in texts]
                columns = [
                    [next(numbers) for _ in part], buckets_of, [g[0] for g in part], [g[1] for g in part],
                    [len(c) for c in texts], texts, [g[2] for g in part],
                ]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SPILL)], schema=SPILL)

        table, groups, held = ContentTable(), [], 0
        for batch in slices(batches):
            ids = batch.column("id").to_pylist()
            if from_rows:
                rows = zip(ids, ids, itertools.repeat(1), map(normalised, utf8(batch, "text")))
            else:
                rows = zip(ids, batch.column("keep").to_pylist(), batch.column("n").to_pylist(), batch.column("content").to_pylist())
            for member, keep, n, content in rows:
                entry = table.place(content)
                if entry == len(groups):
                    groups.append([0, None, []])
                group = groups[entry]
                group[0] += n
                group[1] = _smaller(group[1], keep)
                group[2].append(member)
                held += 8
                if table.bytes + held > table_bytes:
                    yield from flush(table, groups)
                    table, groups, held = ContentTable(), [], 0
        yield from flush(table, groups)

    return spill


def _merge_bucket(rows: pa.Table) -> pa.Table:
    """One bucket: the same keeper, size and digest for all records of equal content."""
    table, groups = ContentTable(), []
    entries = []
    contents = itertools.chain.from_iterable(c.to_pylist() for c in rows.column("content").iterchunks())
    for content, keep, n in zip(contents, rows.column("keep").to_pylist(), rows.column("n").to_pylist()):
        entry = table.place(content)
        if entry == len(groups):
            groups.append([None, 0])
        groups[entry][0] = _smaller(groups[entry][0], keep)
        groups[entry][1] += n
        entries.append(entry)
    digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
    return pa.table(
        [
            rows.column("record").combine_chunks(), pa.array([groups[e][0] for e in entries], pa.int64()),
            pa.array([groups[e][1] for e in entries], pa.int64()), pa.array([digests[e] for e in entries], pa.string()),
        ],
        schema=MERGED_ARROW,
    )


def _spill_table(rows: DataFrame, level: int, total: int, from_rows: bool, bucket_bytes: int, table_bytes: int) -> DataFrame:
    """The spill table of one level: merged records with their bucket."""
    buckets = max(1, -(-total // bucket_bytes))
    schema = "record long, bucket int, n long, keep long, bytes long, content binary, members array<long>"
    path = scratch_path(rows.sparkSession, f"grace-{level}")
    spilled = rows.mapInArrow(_spiller(level, buckets, from_rows, table_bytes), schema)
    spilled.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def grace_dedup(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    levels, solved = [], []
    for level in range(LEVELS):
        spilled = _spill_table(rows, level, total, level == 0, bucket_bytes, table_bytes)
        levels.append(spilled)
        sizes = spilled.groupBy("bucket").agg(F.sum("bytes").alias("held"), F.count("*").alias("records"))
        # a bucket of one record can't be split; at the last level all are taken as they are
        fits = (F.col("held") <= table_bytes) | (F.col("records") == 1) | F.lit(level == LEVELS - 1)
        sizes = materialise(sizes.withColumn("fits", fits), f"grace-sizes-{level}")
        over = sizes.where("not fits").agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
        mine = spilled if not over[0] else spilled.join(sizes.where("fits").select("bucket"), "bucket", "left_semi")
        merged = (
            mine.select("bucket", "record", "n", "keep", "content")
            .groupBy("bucket")
            .applyInArrow(_merge_bucket, MERGED)
        )
        solved.append(materialise(merged, f"grace-merged-{level}"))
        if not over[0]:
            break
        total = over[1]
        rest = spilled.join(sizes.where("not fits").select("bucket"), "bucket", "left_semi")
        rows = rest.select(F.col("record").alias("id"), "n", "keep", "content")
    # from the last level back to the documents
    found = solved[-1]
    for level in range(len(levels) - 1, -1, -1):
        members = levels[level].select("record", "members").join(found, "record").select(
            F.explode("members").alias("record"), "keep", "group_size", "sha"
        )
        found = solved[level - 1].unionByName(members) if level else members
    return found.select(
        F.col("record").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size",
        F.col("record").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and a text, one."""
    kept = grace_dedup(documents, doc_id, text, **options).where("kept").select("doc_id", F.col("text_sha256").alias("same"))
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return only_rows(documents, kept, F.sha2(plain.cast("binary"), 256), doc_id)
