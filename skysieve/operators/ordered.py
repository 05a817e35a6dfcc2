"""Order statistics without ever sorting a whole group in one task.

Quantiles, ranks and AUC all need an order inside a group, and one group may
hold a third of all rows. Quantiles count the values of ever smaller brackets
around the wanted ranks. Ranks and AUC cut the value range of a group into
buckets with a cheap sketch (`percentile_approx`, merged on the map side); bucket
totals give exact offsets, and only the content of one bucket is ordered by one
task. Results are exact; the sketch only decides the cuts.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skysieve.session import materialise

SKETCH_ACCURACY = 20_000
BUCKETS = 256
# a table of per-group cuts is broadcast only when it was counted to be this small
MAX_BROADCAST_GROUPS = 10_000


def small_table(df: DataFrame, limit: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """Per-group table, broadcast if it has at most `limit` rows (checked by fetching them)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _same(left: DataFrame, right: DataFrame, names) -> Column:
    tests = [left[n].eqNullSafe(right[n]) for n in names]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def null_safe_join(left: DataFrame, right: DataFrame, names, how: str = "left") -> DataFrame:
    """Join on group columns where NULL is a group of its own."""
    names = list(names)
    renamed = right.select(
        *[F.col(n).alias(f"_k_{n}") if n in names else F.col(n) for n in right.columns]
    )
    tests = [left[n].eqNullSafe(renamed[f"_k_{n}"]) for n in names]
    joined = left.join(renamed, reduce(lambda a, b: a & b, tests) if tests else F.lit(True), how)
    return joined.drop(*[f"_k_{n}" for n in names])


# --- quantiles ------------------------------------------------------------------------


# cells that one pass cuts a bracket into; rows of a bracket that one task may order
CELLS = 4096
BRACKET_ROWS = 10_000
_LARGEST = 1.7976931348623157e308


def _target(p: float, n: Column) -> Column:
    """0-based fractional position of quantile p among n sorted values."""
    return F.lit(float(p)) * (n - 1)


def _magnitude(value: Column) -> Column:
    """Grows with the value, in steps of its power of two."""
    size = F.log2(F.abs(value)) + 1076
    return F.when(value == 0, 0.0).otherwise(F.when(value > 0, size).otherwise(-size))


def _cell(value: Column, lo: Column, hi: Column, by_magnitude: bool) -> Column:
    """Cell of a value in its bracket; halves keep the width finite, infinities have cells of their own."""
    scale = _magnitude if by_magnitude else lambda v: v / 2
    least, most = scale(F.greatest(lo, F.lit(-_LARGEST))), scale(F.least(hi, F.lit(_LARGEST)))
    at = F.when(most > least, F.floor((scale(value) - least) / (most - least) * CELLS)).otherwise(F.lit(0).cast("long"))
    infinite = F.when(value == float("inf"), CELLS).when(value == float("-inf"), -1)
    return F.coalesce(infinite, F.least(at, F.lit(CELLS - 1))).cast("int")


def _narrowed(long: DataFrame, ranks: DataFrame, keys, by_magnitude: bool) -> DataFrame:
    """Each wanted rank with the smaller bracket that holds it: one counter per cell, combined before the shuffle."""
    brackets = ranks.select(*keys, "_lo", "_hi").distinct()
    rows = null_safe_join(long, brackets, keys, "inner").where("_value >= _lo and _value <= _hi")
    cells = rows.groupBy(*keys, "_lo", _cell(F.col("_value"), F.col("_lo"), F.col("_hi"), by_magnitude).alias("_c")).agg(
        F.count("*").alias("_m"), F.min("_value").alias("_from"), F.max("_value").alias("_to")
    )
    run = W.partitionBy(*keys, "_lo").orderBy("_c").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumn("_through", F.sum("_m").over(run))
    found = null_safe_join(ranks, cells, [*keys, "_lo"], "inner")
    start = F.col("_below") + F.col("_through") - F.col("_m")
    return found.where((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_m"))).select(
        *keys, "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), start.alias("_below"), F.col("_m").alias("_rows")
    )


def _ordered_values(long: DataFrame, ranks: DataFrame, keys) -> DataFrame:
    """The values at the wanted ranks, for brackets that one task may order."""
    brackets = ranks.select(*keys, "_lo", "_hi", "_below").distinct()
    rows = null_safe_join(long, brackets, keys, "inner").where("_value >= _lo and _value <= _hi")
    nth = F.row_number().over(W.partitionBy(*keys, "_lo").orderBy("_value"))
    placed = rows.select(*keys, "_lo", F.col("_value").alias("_at"), (F.col("_below") + nth - 1).alias("_rank"))
    return null_safe_join(ranks.select(*keys, "_lo", "_rank"), placed, [*keys, "_lo", "_rank"], "inner")


def exact_quantiles(df: DataFrame, groups, metrics, probs) -> DataFrame:
    """Interpolated quantiles in long form: groups, metric_name, n_values, q0, q1, ...

    Each wanted rank has a bracket of values, first the whole range of its group. A pass counts the values of a
    bracket in equal cells and keeps the cell that holds the rank, until the bracket holds one value or few enough
    rows for one task to order; every second pass cuts by magnitude, so a wide range takes few. So no task orders more
    than a fixed number of rows, whatever the size of a group. The source is read once: its values are written first.
    """
    groups, metrics, probs = list(groups), list(metrics), list(probs)
    keys = [*groups, "metric_name"]
    long = (
        df.select(*groups, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(groups, metrics, "metric_name", "_value")
        .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    )
    long = materialise(long, "quantile-values")
    whole = materialise(
        long.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")),
        "quantile-groups",
    )
    n = F.col("_n").cast("double")
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_target(p, n)), F.ceil(_target(p, n))) for p in probs])))
    ranks = whole.select(
        *keys, F.explode(wanted).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_rows")
    )
    one_value = F.col("_lo") == F.col("_hi")
    parts = []
    for turn in count():
        parts.append(ranks.where(one_value).select(*keys, "_rank", F.col("_lo").alias("_at")))
        is_small, is_large = ~one_value & (F.col("_rows") <= BRACKET_ROWS), ~one_value & (F.col("_rows") > BRACKET_ROWS)
        small, large = ranks.where(is_small), ranks.where(is_large)
        n_small, n_large = ranks.agg(F.count_if(is_small), F.count_if(is_large)).first()
        if n_small:
            parts.append(_ordered_values(long, small, keys).select(*keys, "_rank", "_at"))
        if not n_large:
            break
        ranks = materialise(_narrowed(long, large, keys, turn % 2 == 1), "quantile-brackets")
    values = reduce(lambda a, b: a.unionByName(b), parts)
    rows = null_safe_join(values, whole.select(*keys, "_n"), keys, "inner")
    picks = []
    for i, p in enumerate(probs):
        for side, at in (("f", F.floor(_target(p, n))), ("c", F.ceil(_target(p, n)))):
            picks.append(F.max(F.when(F.col("_rank") == at, F.col("_at"))).alias(f"_{side}{i}"))
    out = rows.groupBy(*keys, "_n").agg(*picks)
    for i, p in enumerate(probs):
        t = _target(p, n)
        f, c = F.col(f"_f{i}"), F.col(f"_c{i}")
        out = out.withColumn(f"q{i}", F.when(f == c, f).otherwise(f + (c - f) * (t - F.floor(t))))
    return out.select(*keys, F.col("_n").alias("n_values"), *[f"q{i}" for i in range(len(probs))])


def medians(df: DataFrame, groups, named: dict[str, str]) -> DataFrame:
    """One row per group with the median of each column; `named` maps alias to column."""
    long = exact_quantiles(df, groups, list(dict.fromkeys(named.values())), [0.5])
    picks = [
        F.max(F.when(F.col("metric_name") == column, F.col("q0"))).alias(alias)
        for alias, column in named.items()
    ]
    return long.groupBy(*groups).agg(*picks)


def grouped_summary(df: DataFrame, groups, aggregates, named_medians: dict[str, str]) -> DataFrame:
    """Plain aggregates and medians side by side, one row per group."""
    groups = list(groups)
    base = df.groupBy(*groups).agg(*aggregates)
    return null_safe_join(base, medians(df, groups, named_medians), groups)


# --- buckets and positions ------------------------------------------------------------


def with_edge_count(
    df: DataFrame, name: str, value: Column, edges: Column, n_edges: int, *, inclusive: bool = False
) -> DataFrame:
    """Add how many sorted edges lie below `value` (or at it): a binary search in columns.

    Each halving is one small projection, so the lookup stays in generated code.
    """
    out = df.withColumn(name, F.lit(0))
    step = 1 << max(n_edges.bit_length() - 1, 0)
    while step:
        probe = F.get(edges, F.col(name) + (step - 1))
        passed = probe <= value if inclusive else probe < value
        out = out.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0))
        step //= 2
    return out


def with_buckets(df: DataFrame, groups, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add `_bucket`: equal values share a bucket and buckets follow the value order."""
    groups = list(groups)
    marks = [i / buckets for i in range(1, buckets)]
    cuts = F.array_distinct(F.percentile_approx(value, marks, SKETCH_ACCURACY)).alias("_edges")
    if not groups:
        known = df.agg(cuts).first()["_edges"] or []
        if not known:
            return df.withColumn("_bucket", F.lit(0))
        return with_edge_count(df, "_bucket", F.col(value), F.lit(known), len(known))
    edges = df.groupBy(*groups).agg(cuts)
    joined = null_safe_join(df, small_table(edges), groups, "inner")
    return with_edge_count(joined, "_bucket", F.col(value), F.col("_edges"), buckets - 1).drop("_edges")


def spread_row_number(
    df: DataFrame, groups, bucket: str, order, *, name: str = "row_number"
) -> DataFrame:
    """1-based row number inside each group, ordered by `bucket` and then `order`.

    `bucket` must not contradict `order`. A task sorts one (group, bucket) only;
    the offset of a bucket comes from the counted buckets before it.
    """
    groups = list(groups)
    # at most one row per bucket and group reaches this window
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*groups, bucket)
        .agg(F.count("*").alias("_m"))
        .withColumn("_offset", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .drop("_m")
    )
    inner = W.partitionBy(*groups, bucket).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(inner))
    return (
        null_safe_join(ranked, offsets, [*groups, bucket])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_offset")
    )


# --- AUC ------------------------------------------------------------------------------


def grouped_auc(df: DataFrame, groups, value: str, positive: str) -> DataFrame:
    """ROC AUC of `value` against the boolean `positive` per group, ties at half weight.

    Rows shrink to one per distinct value first; the AUC is the share of
    (positive, negative) pairs in the right order, from counts of negatives below.
    NULL when a group has only one of the two sides.
    """
    groups = list(groups) or ["_all"]
    src = df if groups != ["_all"] else df.withColumn("_all", F.lit(1))
    hit = F.col(positive)
    counts = (
        src.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.count_if(hit).alias("_p"), F.count_if(~hit).alias("_n"))
    )
    bucketed = with_buckets(counts, groups, "_v")
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*groups, "_bucket")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_below", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .drop("_bn")
    )
    inner = W.partitionBy(*groups, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = null_safe_join(
        bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))),
        offsets,
        [*groups, "_bucket"],
    )
    pairs = F.col("_p").cast("double") * (F.col("_below") + F.col("_in") + F.col("_n") / 2)
    out = placed.groupBy(*groups).agg(
        F.sum("_p").alias("n_positive"),
        F.sum("_n").alias("n_negative"),
        F.sum(pairs).alias("_pairs"),
    )
    total = F.col("n_positive").cast("double") * F.col("n_negative")
    out = out.withColumn("auc", F.when(total > 0, F.col("_pairs") / total)).drop("_pairs")
    return out.drop("_all")
