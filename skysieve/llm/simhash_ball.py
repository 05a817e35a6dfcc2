"""SimHash near-dedup with meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a point between them that is within half the radius of both. Every
distinct fingerprint therefore emits all variants in that ball (itself and its 64 one-bit neighbours for a radius
of 2), and rows shuffle on the variant. A variant's bucket holds at most as many distinct fingerprints as the ball
has points, so no bucket grows with the data; equal fingerprints were merged before. Within a bucket the smallest
fingerprint is paired with the others: for an even radius all members of a bucket are within the radius of each
other, so the component is the same as with all pairs. Pairs are deduplicated, verified by their distance and
turned into components.

Nulls and odd input: a null, empty or blank text has fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle. Rows that repeat an id are rows of their own; a null id counts as the largest when a
component is named. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from skysieve.llm.components import connected_components
from skysieve.llm.shared import only_rows, slices, utf8
from skysieve.session import materialise

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats included."""
    words = text.lower().split()  # both in ASCII only, as bytes do
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends, digest = (ends - 1).tolist(), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), CHUNK):
        part = hashes[a : a + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(documents: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, same (a hash of the raw text), fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64)
            columns = [batch.column("doc_id"), batch.column("same"), pa.array(found.view(np.int64))]
            yield pa.record_batch(columns, ["doc_id", "same", "fp"])

    body = F.col(text)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("same"), body.alias("text"))
    return rows.mapInArrow(run, "doc_id long, same long, fp long")


def ball_masks(radius: int) -> list[int]:
    """All masks of at most half the radius (rounded up) of bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range((radius + 1) // 2 + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints `fps` (fp): enough of them to connect each component."""
    if radius % 2:
        raise ValueError("the radius must be even: members of a bucket are then within it of each other")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius)])
    variants = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    first = F.min("fp").over(W.partitionBy("variant"))
    pairs = variants.select("fp", first.alias("a")).where("a <> fp").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    return pairs.where(near).select("a", F.col("fp").alias("b"))


def simhash_pairs(
    documents: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pairs (one, two) of different texts, each as a hash of the raw text, that connect every component.

    Texts of one fingerprint form a chain, so none is in more than two of its pairs; linked fingerprints are
    stood for by one text each.
    """
    rows = fingerprints(documents, shingle, doc_id, text).select("fp", "same").distinct()
    texts = materialise(rows, "simhash-texts")
    chain = texts.select(F.lag("same").over(W.partitionBy("fp").orderBy("same")).alias("one"), F.col("same").alias("two"))
    least = materialise(texts.groupBy("fp").agg(F.min("same").alias("same")), "simhash-distinct")
    links = ball_links(least.select("fp"), radius)
    one, two = least.toDF("a", "one"), least.toDF("b", "two")
    return chain.where("one IS NOT NULL").unionAll(links.join(one, "a").join(two, "b").select("one", "two"))


def _members(documents: DataFrame, shingle: int, radius: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, same, fp, component_id, root (equal within a component only)."""
    docs = materialise(fingerprints(documents, shingle, doc_id, text), "simhash")
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(fps.select(F.col("fp").alias("node")), ball_links(fps.select("fp"), radius))
    of = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "first", "root")
    names = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(of.join(names, "root").select("fp", "component_id", "root"), "simhash-named")
    return docs.join(named, "fp")


def simhash_components(
    documents: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = _members(documents, shingle, radius, doc_id, text)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
