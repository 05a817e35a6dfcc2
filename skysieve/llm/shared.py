"""Helpers of several corpus operators: folds, tables read once, batches of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skysieve.session import materialise

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that an operator wrote itself and has no more use for."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def bounded_sample(rows: DataFrame, key: str, bound: int, total: int, seed: int) -> DataFrame:
    """About `bound` of `total` rows, by the hash of a key: the same rows in every run."""
    if total <= bound:
        return rows
    share = bound / total
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


#: Hashes are cut at a share of this range; so shares far below one in a billion stay above zero.
_RANGE = 1 << 52


def sample_per_class(rows: DataFrame, by: str, counts: dict, bound: int, seed: int) -> DataFrame:
    """About `bound` rows of each class `by`, which is never null; `counts`: the rows of each.

    Classes within the bound are taken whole, so no class is lost. Rows are drawn by the hash of (doc_id, text): the
    same in every run, and rows that share an id are drawn one by one.
    """
    if all(n <= bound for n in counts.values()):
        return rows
    spark = rows.sparkSession
    cuts = [(k, _RANGE if n <= bound else max(1, int(bound / n * _RANGE))) for k, n in counts.items()]
    cut = spark.createDataFrame(cuts, f"_class {rows.schema[by].dataType.simpleString()}, _cut long")
    draw = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), F.lit(_RANGE))
    return rows.join(F.broadcast(cut), F.col(by) == F.col("_class")).where(draw < F.col("_cut")).drop("_class", "_cut")


#: Rows that a task turns into Python objects at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without copying."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null counts as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, name: str):
    """Documents with a label `y`, about `bound` per class, outside the held-out fold; and the rows of each class.

    Labels that are null or neither 0 nor 1 are ignored; of several labels of one id the largest counts.
    The sampled labels are bounded by the parameter, so they are broadcast and texts stay where they are.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    picked = [bounded_sample(rows.where(F.col("y") == y), "_id", bound, n, y) for y, n in counts.items()]
    sample = picked[0] if picked else rows
    for more in picked[1:]:
        sample = sample.unionByName(more)
    joined = documents.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")
    return materialise(joined, name), counts


def log_odds(counts: dict) -> float:
    """Of class 1, with one row added to each class."""
    return math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))


def only_rows(documents: DataFrame, keepers: DataFrame, same: Column, doc_id: str = "doc_id") -> DataFrame:
    """One row of `documents` for each keeper (doc_id, same), all columns; `same` tells rows that repeat an id apart.

    Both keys are plain and without nulls, so the join's partitioning serves the final distinct too.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    mine = documents.withColumns({"__id": named(F.col(doc_id)), "__same": same})
    theirs = keepers.select(named(F.col("doc_id")).alias("__id"), F.col("same").alias("__same"))
    return mine.join(theirs, ["__id", "__same"], "left_semi").dropDuplicates(["__id", "__same"]).select(*documents.columns)
