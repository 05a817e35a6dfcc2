"""Linking an external catalogue to the survey: sky match, match choice, labels, batches."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.labels import parse_label
from skysieve.operators.distributions import count_flags
from skysieve.operators.ordered import spread_row_number, with_buckets
from skysieve.operators.skew import balanced_join, with_group_count

MATCH_RADIUS_ARCSEC = 5.0
SEPARATION_BUCKETS = 64


def require_batch_id(batch_id: str) -> str:
    if not re.match(C.BATCH_ID_PATTERN, batch_id):
        raise ValueError(f"bad cross-match batch id {batch_id!r}")
    return batch_id


# --- sky match ------------------------------------------------------------------------


def separation_degrees(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula; stable for tiny angles."""
    d = F.sin(F.radians(dec2 - dec1) / 2.0)
    a = F.sin(F.radians(ra2 - ra1) / 2.0)
    h = d * d + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * a * a
    return F.degrees(2.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def _ra_cells(zone: Column, height: float) -> Column:
    """Number of RA cells in a Dec zone: each at least the match radius wide on the sky.

    Measured at the highest |Dec| of the zone and its neighbour, with ten percent
    to spare; close to a pole the whole zone is one cell.
    """
    low = zone * height - 90.0
    top = F.greatest(F.abs(low), F.abs(low + height)) + height
    n = F.floor(360.0 * F.cos(F.radians(F.least(top, F.lit(90.0)))) / (1.1 * height))
    return F.when(n >= 8, n).otherwise(1).cast("long")


def _ra_cell(ra: Column, n: Column) -> Column:
    return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n), n - 1).cast("long")


def sky_match(
    external: DataFrame,
    survey: DataFrame,
    *,
    radius_arcsec: float = MATCH_RADIUS_ARCSEC,
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """All (external_row_id, source_id) pairs within the radius, SEPARATION in degrees.

    The sky is cut into cells as small as the radius allows. A survey row lives in
    one cell; an external row visits its 3 x 3 neighbourhood. The equi-join on
    cells therefore tests about three candidates per true pair, and crowded
    cells are cut into parts.
    """
    radius = radius_arcsec / 3600.0
    height = radius * 1.0001
    zones = math.ceil(180.0 / height)

    def zone_of(dec: Column) -> Column:
        return F.least(F.floor((dec + 90.0) / height), F.lit(zones - 1)).cast("long")

    homes = survey.where(F.col("ra").isNotNull() & F.col("dec").isNotNull()).withColumn(
        "_zone", zone_of(F.col("dec"))
    )
    homes = homes.withColumn("_cell", _ra_cell(F.col("ra"), _ra_cells(F.col("_zone"), height)))

    visits = (
        external.where(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull())
        .withColumn("_home", zone_of(F.col("dec_deg")))
        .withColumn("_zone", F.explode(F.sequence(F.col("_home") - 1, F.col("_home") + 1)))
        .where((F.col("_zone") >= 0) & (F.col("_zone") < zones))
        .withColumn("_cells", _ra_cells(F.col("_zone"), height))
        .withColumn("_at", _ra_cell(F.col("ra_deg"), F.col("_cells")))
        .withColumn(
            "_cell",
            F.explode(
                F.array_distinct(
                    F.array(*[F.pmod(F.col("_at") + step, F.col("_cells")) for step in (-1, 0, 1)])
                )
            ),
        )
        .drop("_home", "_cells", "_at")
    )
    pairs = balanced_join(
        visits,
        homes,
        ["_zone", "_cell"],
        left_spread=F.col("external_row_id"),
        right_spread=F.col("source_id"),
        rows_per_task=rows_per_task,
    ).drop("_zone", "_cell")
    distance = separation_degrees(F.col("ra_deg"), F.col("dec_deg"), F.col("ra"), F.col("dec"))
    return pairs.withColumn("SEPARATION", distance).where(F.col("SEPARATION") <= radius)


# --- choice of matches ----------------------------------------------------------------


def distinct_matches(landing: DataFrame) -> DataFrame:
    """Complete pairs, repeats of a pair reduced to the smallest separation."""
    return (
        landing.where(
            F.col("external_row_id").isNotNull()
            & F.col("source_id").isNotNull()
            & F.col("SEPARATION").isNotNull()
        )
        .groupBy(
            F.col("external_row_id").cast("long").alias("external_row_id"),
            F.col("source_id").cast("long").alias("source_id"),
        )
        .agg(F.min(F.col("SEPARATION").cast("double")).alias("SEPARATION"))
    )


def rank_matches(landing: DataFrame, batch_id: str) -> DataFrame:
    """Matches of every external row in order of separation, then id.

    A row with very many matches is ranked in separation steps, so that no task
    orders all of them.
    """
    step = MATCH_RADIUS_ARCSEC / SEPARATION_BUCKETS
    matches = distinct_matches(landing).withColumn(
        "xmatch_separation_arcsec", F.col("SEPARATION") * 3600.0
    )
    matches = matches.withColumn(
        "_bucket",
        F.least(F.floor(F.col("xmatch_separation_arcsec") / step), F.lit(SEPARATION_BUCKETS)),
    )
    ranked = spread_row_number(
        matches, ["external_row_id"], "_bucket", ["SEPARATION", "source_id"], name="xmatch_rank"
    )
    return ranked.select(
        F.lit(require_batch_id(batch_id)).alias("xmatch_batch_id"),
        "external_row_id",
        "source_id",
        "xmatch_separation_arcsec",
        F.col("xmatch_rank").cast("int").alias("xmatch_rank"),
        (F.col("xmatch_rank") == 1).alias("xmatch_selected"),
    )


def best_matches(landing: DataFrame, batch_id: str) -> DataFrame:
    """Only the selected match per external row: one aggregate, no ranking."""
    best = (
        landing.where(F.col("SEPARATION").isNotNull() & F.col("source_id").isNotNull())
        .groupBy(F.col("external_row_id").cast("long").alias("external_row_id"))
        .agg(
            F.min(
                F.struct(
                    F.col("SEPARATION").cast("double").alias("s"),
                    F.col("source_id").cast("long").alias("id"),
                )
            ).alias("m")
        )
        .where(F.col("external_row_id").isNotNull())
    )
    return best.select(
        F.lit(require_batch_id(batch_id)).alias("xmatch_batch_id"),
        "external_row_id",
        F.col("m.id").alias("source_id"),
        (F.col("m.s") * 3600.0).alias("xmatch_separation_arcsec"),
        F.lit(True).alias("xmatch_selected"),
    )


def match_counts(matches: DataFrame) -> DataFrame:
    """Load counts of one batch: rows, distinct rows, selected, rows with several matches."""
    return (
        matches.groupBy("external_row_id")
        .agg(F.count("*").alias("n"), F.count_if("xmatch_selected").alias("s"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_loaded"),
            F.count("*").alias("distinct_external_rows"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("selected_rows"),
            F.count_if(F.col("n") > 1).alias("multi_match_external_rows"),
        )
    )


# --- labels ---------------------------------------------------------------------------


def with_conflict_count(rows: DataFrame, *, rows_per_task: int = 1_000_000) -> DataFrame:
    """How many selected matches share the source id.

    Counted first and joined back: a source that collects a third of all rows
    is one counter, and its rows stay spread over tasks.
    """
    return with_group_count(
        rows,
        "source_id",
        "source_conflict_count",
        spread=F.col("external_row_id"),
        rows_per_task=rows_per_task,
    )


def labeled_source(
    matches: DataFrame, filtered: DataFrame, batch_id: str, limit: int | None = None
) -> DataFrame:
    """Selected matches of a batch with their catalogue record and conflict count."""
    chosen = matches.where(
        (F.col("xmatch_batch_id") == require_batch_id(batch_id)) & F.col("xmatch_selected")
    ).select("xmatch_batch_id", "source_id", "external_row_id", "xmatch_separation_arcsec")
    record = filtered.select(
        "external_row_id", "external_catalog_name", "external_object_id", "raw_sptype"
    )
    out = with_conflict_count(chosen.join(record, "external_row_id"))
    return out if limit is None else out.orderBy("external_row_id").limit(limit)


def label_rows(source: DataFrame) -> DataFrame:
    """Parsed label and conflict flag beside each row."""
    return source.withColumn("p", parse_label(F.col("raw_sptype"))).select(
        "xmatch_batch_id",
        "source_id",
        "external_row_id",
        "external_catalog_name",
        "external_object_id",
        "raw_sptype",
        "p.spectral_class",
        "p.spectral_subclass",
        "p.luminosity_class",
        "p.peculiarity_suffix",
        F.col("p.parse_status").alias("label_parse_status"),
        F.col("p.parse_note").alias("label_parse_notes"),
        "xmatch_separation_arcsec",
        (F.col("source_conflict_count") > 1).alias("has_source_conflict"),
        "source_conflict_count",
    )


def labeled_counts(labeled: DataFrame) -> DataFrame:
    """Load counts of the labelled table in one row."""
    status = F.col("label_parse_status")
    per_source = labeled.groupBy("source_id").agg(
        F.count("*").alias("n"),
        *count_flags(
            {
                "parsed_rows": status == "parsed",
                "partial_rows": status == "partial",
                "unsupported_rows": status == "unsupported",
                "empty_rows": status == "empty",
                "rows_without_luminosity_class": F.col("luminosity_class").isNull(),
            }
        ),
    )
    distinct_rows = labeled.agg(F.countDistinct("external_row_id")).scalar()
    return per_source.agg(
        F.sum("n").alias("rows_loaded"),
        F.count("*").alias("distinct_source_ids"),
        F.count_if(F.col("n") > 1).alias("duplicate_source_ids"),
        *[
            F.sum(c).alias(c)
            for c in (
                "parsed_rows",
                "partial_rows",
                "unsupported_rows",
                "empty_rows",
                "rows_without_luminosity_class",
            )
        ],
    ).withColumn("distinct_external_rows", distinct_rows)


# --- batches --------------------------------------------------------------------------


def write_batch(df: DataFrame, path: str) -> None:
    """Replace the batches present in `df`, leave all others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "xmatch_batch_id"
    ).parquet(path)


def enrichment_ids(
    labeled: DataFrame, batch_id: str, *, only_conflict_free: bool = True, limit: int | None = None
) -> DataFrame:
    """Distinct ids of a batch that need survey parameters (S21); in id order where a limit needs one."""
    rows = labeled.where(
        (F.col("xmatch_batch_id") == require_batch_id(batch_id)) & F.col("source_id").isNotNull()
    )
    if only_conflict_free:
        rows = rows.where(~F.col("has_source_conflict"))
    out = rows.select(F.col("source_id").cast("long").alias("source_id")).distinct()
    return out if limit is None else out.orderBy("source_id").limit(limit)


def id_batches(ids: DataFrame, batch_size: int = 50_000) -> DataFrame:
    """Number ids in order and cut them into batches of fixed size."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    numbered = spread_row_number(with_buckets(ids, [], "source_id"), [], "_bucket", ["source_id"])
    return numbered.select(
        "source_id",
        (F.floor((F.col("row_number") - 1) / batch_size) + 1).cast("long").alias("batch_index"),
    )


def batch_manifest(batches: DataFrame) -> DataFrame:
    return (
        batches.groupBy("batch_index")
        .agg(
            F.count("*").alias("rows_exported"),
            F.min("source_id").alias("source_id_min"),
            F.max("source_id").alias("source_id_max"),
        )
        .withColumn(
            "csv_filename",
            F.format_string("bmk_gaia_enrichment_batch_%04d.csv", F.col("batch_index")),
        )
    )


def export_batches(batches: DataFrame, path: str) -> None:
    """One directory per batch; the manifest is the table of what is in them."""
    batches.repartition("batch_index").write.mode("overwrite").partitionBy("batch_index").csv(
        path, header=True
    )
