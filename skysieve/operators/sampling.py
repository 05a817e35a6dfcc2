"""Exact stratified splits, folds and matched samples without sorting a stratum in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skysieve import contracts as C
from skysieve.operators.distributions import as_label
from skysieve.operators.ordered import null_safe_join, small_table, spread_row_number

# order keys are integers below 2^31; their upper bits make 512 even buckets
KEY_RANGE = 2_147_483_647
BUCKET_SHIFT = 22


def shuffle_key(seed: int, key: str = "source_id") -> Column:
    """Pseudo-random order that depends on seed and id only, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(KEY_RANGE))


def stratum(columns) -> Column:
    return F.concat_ws("|", *[as_label(F.col(c)) for c in columns])


def random_position(df: DataFrame, groups, order_key: Column, name: str = "position") -> DataFrame:
    """1-based position of each row in the random order of its group."""
    keyed = df.withColumn("_key", order_key.cast("long")).withColumn(
        "_bucket", F.shiftright("_key", BUCKET_SHIFT)
    )
    out = spread_row_number(keyed, groups, "_bucket", ["_key", F.col("source_id").cast("string")], name=name)
    return out.drop("_key", "_bucket")


def split_quotas(df: DataFrame, strata, protocol: C.Protocol = C.Protocol()) -> DataFrame:
    """Test rows per stratum; largest remainders make the sum ceil(share * rows)."""
    counts = df.groupBy(stratum(strata).alias("stratum")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    n_test = F.ceil(F.lit(protocol.test_share) * total)
    # one row per stratum from here on
    exact = counts.withColumn("_exact", n_test * F.col("n") / total).withColumn("_n_test", n_test)
    exact = exact.withColumn("_base", F.floor("_exact"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_base")), "stratum"))
    spare = F.col("_n_test") - F.sum("_base").over(whole)
    return exact.withColumn("_rank", rank).select(
        "stratum",
        "n",
        (F.col("_base") + F.when(F.col("_rank") <= spare, 1).otherwise(0)).cast("long").alias("n_test"),
    )


def require_splittable(df: DataFrame, strata, protocol: C.Protocol) -> None:
    counts = df.groupBy(stratum(strata).alias("stratum")).agg(F.count("*").alias("n"))
    row = counts.agg(
        F.sum("n").alias("rows"), F.count("*").alias("strata"), F.min_by("stratum", "n").alias("rarest"), F.min("n").alias("least")
    ).first()
    if not row["rows"]:
        raise ValueError("cannot split an empty dataset")
    if row["least"] < 2:
        raise ValueError(f"every stratum needs two rows or more; {row['rarest']} has one")
    n_test = -(-int(row["rows"] * protocol.test_share * 1_000_000) // 1_000_000)
    if n_test < row["strata"]:
        raise ValueError(f"test part of {n_test} rows is too small for {row['strata']} strata")


def stratified_split(
    df: DataFrame,
    strata,
    protocol: C.Protocol = C.Protocol(),
    *,
    order_key: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Add `split_name` train/test with an exact quota per stratum."""
    if check:
        require_splittable(df, strata, protocol)
    key = shuffle_key(protocol.seed) if order_key is None else order_key
    placed = random_position(df.withColumn("stratum", stratum(strata)), ["stratum"], key)
    quotas = small_table(split_quotas(df, strata, protocol).select("stratum", "n_test"))
    return (
        null_safe_join(placed, quotas, ["stratum"])
        .withColumn("split_name", F.when(F.col("position") <= F.col("n_test"), "test").otherwise("train"))
        .drop("stratum", "position", "n_test")
    )


def stratified_folds(
    df: DataFrame,
    target: str,
    protocol: C.Protocol = C.Protocol(),
    *,
    order_key: Column | None = None,
) -> DataFrame:
    """Add `fold` 0..k-1, even inside every label."""
    key = shuffle_key(protocol.seed) if order_key is None else order_key
    placed = random_position(df, [target], key)
    return placed.withColumn(
        "fold", F.pmod(F.col("position") - 1, F.lit(protocol.folds)).cast("int")
    ).drop("position")


# --- hosts and field stars ------------------------------------------------------------

GROUP = ("spec_class", "evolution_stage")
HOST_FIELD_COLUMNS = C.ordered_union(("source_id",), GROUP, ("spec_subclass",), C.ROUTER_FEATURES, ("host_label",))


def target_hosts(df: DataFrame) -> DataFrame:
    return df.where(F.col("spec_class").isin(*C.TARGET_CLASSES))


def field_pool(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Target-class rows that are no known hosts; ids compare as text."""
    known = hosts.select(F.col("source_id").cast("string").alias("_id")).distinct()
    pool = df.where(F.col("spec_class").isin(*C.TARGET_CLASSES))
    return pool.join(known, pool["source_id"].cast("string") == known["_id"], "left_anti")


def sample_shortfalls(pool: DataFrame, hosts: DataFrame, ratio: int) -> DataFrame:
    """Groups whose field pool is too small for the wanted sample."""
    need = hosts.groupBy(*GROUP).agg((F.count("*") * ratio).alias("need"))
    have = pool.groupBy(*GROUP).agg(F.count("*").alias("have"))
    return null_safe_join(need, have, GROUP).where(F.coalesce("have", F.lit(0)) < F.col("need"))


def matched_field_sample(
    pool: DataFrame,
    hosts: DataFrame,
    *,
    ratio: int = 1,
    seed: int = 42,
    order_key: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Per (class, stage) as many random field rows as hosts times ratio."""
    if ratio < 1:
        raise ValueError("field-to-host ratio must be at least 1")
    if check:
        short = sample_shortfalls(pool, hosts, ratio).first()
        if short:
            raise ValueError(
                f"field pool has {short['have'] or 0} rows for ({short['spec_class']}, "
                f"{short['evolution_stage']}), {short['need']} needed"
            )
    key = shuffle_key(seed) if order_key is None else order_key
    need = small_table(hosts.groupBy(*GROUP).agg((F.count("*") * ratio).alias("_need")))
    placed = random_position(pool, GROUP, key)
    joined = null_safe_join(placed, need, GROUP, "inner")
    return joined.where(F.col("position") <= F.col("_need")).drop("position", "_need")


def host_field_dataset(
    hosts: DataFrame, router: DataFrame, *, ratio: int = 1, seed: int = 42, order_key=None, check: bool = True
) -> DataFrame:
    """Hosts and their matched field stars with `host_label`."""
    chosen = target_hosts(hosts)
    sample = matched_field_sample(
        field_pool(router, chosen), chosen, ratio=ratio, seed=seed, order_key=order_key, check=check
    )
    both = chosen.withColumn("host_label", F.lit("host")).unionByName(
        sample.withColumn("host_label", F.lit("field")), allowMissingColumns=True
    )
    have = set(both.columns)
    return both.select(*[c for c in HOST_FIELD_COLUMNS if c in have])
