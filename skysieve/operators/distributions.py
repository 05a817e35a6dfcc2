"""Value distributions, crosstabs and other one-pass count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<NA>"


def as_label(c: Column) -> Column:
    """Text of a cell; a missing one gets a fixed spelling."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def with_share(counts: DataFrame, *, name: str = "share", count: str = "n_rows", within=()) -> DataFrame:
    """Add each row's part of the total; `counts` is a small aggregated table."""
    within = list(within)
    if within:
        totals = counts.groupBy(*within).agg(F.sum(count).alias("_total"))
        joined = counts.join(totals, within, "left")
    else:
        total = counts.agg(F.sum(count)).scalar()
        return counts.withColumn(name, F.col(count) / total)
    return joined.withColumn(name, F.col(count) / F.col("_total")).drop("_total")


def distribution(
    df: DataFrame,
    column: str,
    label: str | None = None,
    *,
    top_n: int | None = None,
    drop_blank: bool = False,
    keep_null: bool = False,
) -> DataFrame:
    """label, n_rows, share; most frequent first, ties by label."""
    label = label or column
    cell = F.col(column).cast("string") if keep_null else as_label(F.col(column))
    src = df.where(F.trim(F.col(column).cast("string")) != "") if drop_blank else df
    counts = src.groupBy(cell.alias(label)).agg(F.count("*").alias("n_rows"))
    out = with_share(counts)
    if top_n is None:
        return out
    return out.orderBy(F.desc("n_rows"), F.asc_nulls_first(label)).limit(top_n)


def group_distribution(df: DataFrame, group: str, column: str, label: str | None = None) -> DataFrame:
    """Share of each value inside its group."""
    label = label or column
    counts = df.groupBy(as_label(F.col(group)).alias(group), as_label(F.col(column)).alias(label)).agg(
        F.count("*").alias("n_rows")
    )
    return with_share(counts, name="share_within_group", within=[group])


def crosstab(df: DataFrame, rows: str, columns: str, values) -> DataFrame:
    """Counts of `columns` values beside each value of `rows`; the value list is given."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).cast("long").alias(v) for v in values]
    )


def count_flags(named: dict[str, Column]) -> list[Column]:
    return [F.count_if(test).alias(name) for name, test in named.items()]


def to_metric_rows(one_row: DataFrame, names=None) -> DataFrame:
    """Turn a one-row summary into (metric_name, metric_value) rows."""
    names = list(names or one_row.columns)
    return one_row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [], names, "metric_name", "metric_value"
    )
