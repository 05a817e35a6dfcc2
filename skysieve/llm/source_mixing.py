"""Mixing sources to target weights, in column expressions only.

Each document gets a random key from the hash of its id. Within a source the keys cut the rows into ranges of a
few thousand rows; sums over the ranges give each range the words before it, and a running sum inside the range
gives each document its own. A source is then cut at exactly its budget: whole epochs first, then documents in
key order until the budget is spent, the last one in part.

Nulls and odd input: a null text has size 0 and takes nothing; null sources form one source, ordered last. A null
id is hashed like the empty text. Rows that repeat an id are ordered by size and text, so reruns agree. An empty
table, or one without words, gives targets of 0. Extra columns pass through in `mixed_documents`; `mix_sources`
returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skysieve.llm.shared import WORD
from skysieve.session import materialise

#: Rows of one range, on average; sources that may be broadcast.
RANGE_ROWS, SOURCES = 4096, 100_000
SPAN = 1 << 60


def random_key(doc_id: Column) -> Column:
    """60 bits of the id's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """One row per source: source, source_rows, source_size, target.

    All sources share `share` times all words by weight; a target stops at `limit` times its source's size and
    the excess goes to the others by weight. Sources in the order of limit/weight fill up one after another, so
    running sums over the sources find the level at which nothing is left to share.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights)))))
    everything = W.partitionBy()
    per = per.withColumn("cap", limit * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    # the level if all sources before this one stop at their limit and this and the later ones don't
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    # levels fall after the first source that doesn't stop; its own is the one that all the others share
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(common * F.col("weight"))
    return per.select("source", "source_rows", "source_size", target.alias("target"))


def mix_sources(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the columns to keep as a struct `kept`."""
    body = F.col(text)
    sizes = materialise(
        documents.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(body).alias("size"),
            random_key(F.col(doc_id)).alias("key"), F.xxhash64(body).alias("same"),
            *[F.struct(*keep).alias("kept")] * bool(keep),
        ),
        "mix-sizes",
    )
    plan = materialise(targets(sizes, weights, share, limit), "mix-targets")
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null apart from the empty name
    plan = plan.select(
        named.alias("_s"), "source_size", "target",
        F.expr(f"{SPAN} div greatest(1, ceil(source_rows / {RANGE_ROWS})) + 1").alias("_width"),
    )
    if plan.count() <= SOURCES:
        plan = F.broadcast(plan)
    rows = sizes.withColumn("_s", named).drop("source").join(plan, "_s").withColumn("range", F.expr("key div _width"))
    sums = rows.groupBy("_s", "range").agg(F.sum("size").alias("words"))
    before = W.partitionBy("_s").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_s", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("_s", "range").orderBy("key", "doc_id", "size", "same").rowsBetween(W.unboundedPreceding, -1)
    ordered = rows.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = ordered.join(starts, ["_s", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - (F.col("start") + F.col("run"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return found.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *["kept"] * bool(keep)
    )


def mixed_documents(documents: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself: a row for each time that a document is taken; a last part keeps the first words of its text."""
    mix = mix_sources(documents, text=text, keep=tuple(documents.columns), **options).where("taken > 0")
    mix = mix.withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    part = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    rows = mix.select("size", part.alias("part"), F.col("kept")[text].alias("whole"), "kept")
    every = F.filter(F.split("whole", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(every, F.lit(1), F.col("part").cast("int")), " ")
    short = F.col("part") < F.col("size")
    new = {text: F.when(short, cut).otherwise(F.col("whole"))}
    if n_chars in documents.columns:
        new[n_chars] = F.when(short, F.length(cut).cast("long")).otherwise(F.col("kept")[n_chars])
    return rows.select(*[new.get(c, F.col("kept")[c]).alias(c) for c in documents.columns])
