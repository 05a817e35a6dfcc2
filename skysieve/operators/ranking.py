"""Priority ranking of candidate stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import scores as S
from skysieve.functions.numeric import strict_number
from skysieve.operators.guards import require_columns
from skysieve.operators.ordered import spread_row_number, with_buckets

RANKING_COLUMNS = (
    "source_id",
    "spec_class",
    "evolution_stage",
    "class_priority_score",
    "host_similarity_score",
    "brightness_score",
    "distance_score",
    "astrometry_score",
    "observability_score",
    "brightness_available",
    "distance_available",
    "astrometry_available",
    "observability_evidence_count",
    "priority_score",
    "priority_label",
    "priority_reason",
)
# what a ranking adds to a decision row
PRIORITY_COLUMNS = RANKING_COLUMNS[3:]


def score_priority(
    df: DataFrame,
    *,
    host_column: str = "host_similarity_score",
    weights: C.PriorityWeights = C.PriorityWeights(),
    cuts: C.PriorityThresholds = C.PriorityThresholds(),
) -> DataFrame:
    """One scored row per input row; a pure projection, so it fuses into the scan stage."""
    require_columns(df, ("source_id", "spec_class", host_column), "ranking frame")
    stage = F.col("evolution_stage") if "evolution_stage" in df.columns else F.lit(None)
    signals = {
        name: strict_number(df, name)
        for name in ("phot_g_mean_mag", "parallax", "parallax_over_error", "ruwe", "validation_factor")
    }
    base = df.select(
        F.col("source_id").cast("string").alias("source_id"),
        F.upper(F.trim(F.col("spec_class").cast("string"))).alias("spec_class"),
        stage.cast("string").alias("evolution_stage"),
        S.host_score(strict_number(df, host_column)).alias("host_similarity_score"),
        *[c.alias(f"_{name}") for name, c in signals.items()],
    )
    observed = base.withColumns(
        S.observability_columns(
            F.col("_phot_g_mean_mag"),
            F.col("_parallax"),
            F.col("_parallax_over_error"),
            F.col("_ruwe"),
            F.col("_validation_factor"),
        )
    ).withColumn(
        "class_priority_score",
        S.class_priority_score(F.col("spec_class"), F.col("evolution_stage"), cuts),
    )
    scored = observed.withColumn(
        "priority_score",
        S.priority_score(
            F.col("spec_class"),
            F.col("class_priority_score"),
            F.col("host_similarity_score"),
            F.col("observability_score"),
            weights,
            cuts,
        ),
    )
    return scored.withColumns(
        {
            "priority_label": S.priority_label(F.col("priority_score"), cuts.high, cuts.medium),
            "priority_reason": S.priority_reason(
                F.col("spec_class"),
                F.col("evolution_stage"),
                F.col("host_similarity_score"),
                F.col("observability_score"),
                F.col("observability_evidence_count"),
            ),
        }
    ).select(*RANKING_COLUMNS)


def ranking_order():
    """Best first; the id as text makes the order total."""
    return [
        F.desc("priority_score"),
        F.desc("host_similarity_score"),
        F.desc("observability_score"),
        F.asc("source_id"),
    ]


def rank_stars(df: DataFrame, **options) -> DataFrame:
    """Scored rows in ranking order (a range-partitioned sort, meant for a sink)."""
    return score_priority(df, **options).orderBy(*ranking_order())


def numbered_ranking(df: DataFrame, **options) -> DataFrame:
    """Scored rows with their `place` in ranking order, counted bucket by bucket instead of by one sort."""
    scored = score_priority(df, **options).withColumn("_worse", -F.col("priority_score"))
    rows = with_buckets(scored, [], "_worse")
    return spread_row_number(rows, [], "_bucket", ranking_order(), name="place").drop("_worse", "_bucket")


def sort_by_id(df: DataFrame) -> DataFrame:
    """Order by id as text: '10' comes before '9'."""
    return df.orderBy(F.col("source_id").cast("string"))
