"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.session import materialise

ROWS_PER_TASK = 1_000_000
# ids that may be broadcast: about 40 MB
MAX_BROADCAST_IDS = 1_000_000


def by_shuffle(df: DataFrame) -> DataFrame:
    """Star table on the right of a join: it has as many rows as stars, but few bytes on disk.

    Left to its estimate, Spark broadcasts 9 million rows that are packed into less than 10 MB.
    """
    return df.hint("merge")


def broadcast_ids(ids: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Distinct ids on the right of a join with wide star rows: broadcast if there are at most `limit` (counted).

    Left to the estimate from the bytes of the files they come from, Spark shuffles all columns of all stars to test
    one id. Beyond the limit that is what remains.
    """
    return F.broadcast(ids) if ids.count() <= limit else by_shuffle(ids)


def hot_keys(df: DataFrame, keys, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should take, and into how many parts to split them.

    At most rows / rows_per_task keys can qualify, which bounds the table.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys,
    *,
    left_spread: Column,
    right_spread: Column,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner equi-join where keys that are hot on either side are cut into parts.

    The spread columns tell the rows of a side apart. A row belongs to one part of
    its own side and meets every part of the other side, so each pair is met
    exactly once. Cold keys have one part and are not copied.
    """
    keys = list(keys)
    hot_left = F.broadcast(hot_keys(left, keys, rows_per_task).withColumnRenamed("_parts", "_lp"))
    hot_right = F.broadcast(hot_keys(right, keys, rows_per_task).withColumnRenamed("_parts", "_rp"))

    def cut(df: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        marked = (
            df.withColumn("_spread", F.xxhash64(spread)).join(hot_left, keys, "left").join(hot_right, keys, "left")
        )
        mine = F.pmod("_spread", F.coalesce(own, F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return (
            marked.withColumn("_own", mine)
            .withColumn("_other", others)
            .drop("_spread", "_lp", "_rp")
            .withColumnsRenamed({"_own": f"_part{own}", "_other": f"_part{other}"})
        )

    return (
        cut(left, left_spread, "_lp", "_rp")
        .join(cut(right, right_spread, "_rp", "_lp"), [*keys, "_part_lp", "_part_rp"])
        .drop("_part_lp", "_part_rp")
    )


def with_group_count(
    df: DataFrame, key: str, name: str, *, spread: Column, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each row with the number of rows that share its key.

    The counts themselves tell which keys are hot: their counter is copied to the
    parts into which the rows of the key are cut. `df` is written once, as it is
    read twice. Keys must not be NULL.
    """
    df = materialise(df, "counted-rows")
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    parts = F.ceil(F.col(name) / rows_per_task).cast("int")
    hot = F.broadcast(counts.where(F.col(name) > rows_per_task).select(key, parts.alias("_parts")))
    copies = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = (
        df.join(hot, key, "left")
        .withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )
    return rows.join(copies, [key, "_part"]).drop("_part")
