"""Observability and priority scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.labels import normalize_stage
from skysieve.functions.numeric import NEUTRAL_SCORE, clip01, linear_score

# --- fixed values: score ranges and mixing weights ------------------------------------

BRIGHTNESS_RANGE_MAG = (10.0, 16.0)
DISTANCE_RANGE_MAS = (2.0, 20.0)
SNR_RANGE = (5.0, 20.0)
RUWE_RANGE = (1.0, 1.4)
OBSERVABILITY_MIX = (0.40, 0.35, 0.25)
LOW_CLASS_SCORE = 0.20


def brightness_score(mag: Column) -> Column:
    return linear_score(mag, *BRIGHTNESS_RANGE_MAG, rising=False)


def distance_score(parallax: Column) -> Column:
    return linear_score(parallax, *DISTANCE_RANGE_MAS)


def astrometry_score(snr: Column, ruwe: Column, validation: Column) -> Column:
    """Mean of the parts that are there; neutral when none is."""
    parts = [
        (snr, linear_score(snr, *SNR_RANGE)),
        (ruwe, linear_score(ruwe, *RUWE_RANGE, rising=False)),
        (validation, clip01(validation)),
    ]
    total, n = F.lit(0.0), F.lit(0)
    for source, score in parts:
        total = total + F.when(source.isNotNull(), score).otherwise(0.0)
        n = n + source.isNotNull().cast("int")
    return F.when(n > 0, clip01(total / n)).otherwise(NEUTRAL_SCORE)


def observability_columns(
    mag: Column, parallax: Column, snr: Column, ruwe: Column, validation: Column
) -> dict[str, Column]:
    has_mag, has_parallax = mag.isNotNull(), parallax.isNotNull()
    has_astrometry = snr.isNotNull() | ruwe.isNotNull() | validation.isNotNull()
    b, d, a = OBSERVABILITY_MIX
    bright, near = brightness_score(mag), distance_score(parallax)
    precise = astrometry_score(snr, ruwe, validation)
    return {
        "brightness_score": bright,
        "distance_score": near,
        "astrometry_score": precise,
        "observability_score": clip01(F.lit(b) * bright + F.lit(d) * near + F.lit(a) * precise),
        "brightness_available": has_mag,
        "distance_available": has_parallax,
        "astrometry_available": has_astrometry,
        "observability_evidence_count": (
            has_mag.cast("int") + has_parallax.cast("int") + has_astrometry.cast("int")
        ),
    }


def class_priority_score(
    spec_class: Column, stage: Column, cuts: C.PriorityThresholds = C.PriorityThresholds()
) -> Column:
    letter = F.upper(F.trim(spec_class))
    is_target = letter.isin(*C.TARGET_CLASSES)
    score = (
        F.when(is_target & (normalize_stage(stage) == "evolved"), 1.0 - cuts.evolved_penalty)
        .when(is_target, 1.0)
        .when(letter.isin(*C.LOW_PRIORITY_CLASSES), LOW_CLASS_SCORE)
        .otherwise(NEUTRAL_SCORE)
    )
    return clip01(score)


def host_score(value: Column) -> Column:
    return F.when(value.isNotNull(), clip01(value)).otherwise(NEUTRAL_SCORE)


def priority_score(
    spec_class: Column,
    class_score: Column,
    host: Column,
    observability: Column,
    weights: C.PriorityWeights = C.PriorityWeights(),
    cuts: C.PriorityThresholds = C.PriorityThresholds(),
) -> Column:
    score = clip01(
        F.lit(weights.class_priority) * class_score
        + F.lit(weights.host_similarity) * host
        + F.lit(weights.observability) * observability
    )
    capped = F.upper(F.trim(spec_class)).isin(*C.LOW_PRIORITY_CLASSES)
    return F.when(capped, F.least(score, F.lit(cuts.low_class_cap))).otherwise(score)


def priority_label(score: Column, high, medium) -> Column:
    """`high` and `medium` may be numbers or columns of a policy table."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def priority_reason(
    spec_class: Column, stage: Column, host: Column, observability: Column, evidence: Column
) -> Column:
    """Reason texts in rule order, joined by '; '."""
    said = C.PRIORITY_REASONS
    letter = F.upper(F.trim(spec_class))
    parts = F.concat_ws(
        "; ",
        F.when(letter.isin(*C.LOW_PRIORITY_CLASSES), said["low_priority_class"]).when(
            normalize_stage(stage) == "evolved", said["evolved_stage_penalty"]
        ),
        F.when(host >= 0.75, said["strong_host_signal"]).when(host <= 0.35, said["weak_host_signal"]),
        F.when(observability >= 0.70, said["good_observability"]).when(
            observability <= 0.35, said["limited_observability"]
        ),
        F.when(evidence == 0, said["observability_without_inputs"]).when(
            evidence < 3, said["observability_with_partial_inputs"]
        ),
    )
    return F.when(parts == "", said["balanced_profile"]).otherwise(parts)
