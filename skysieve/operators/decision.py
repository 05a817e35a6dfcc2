"""Routing of stars: quality gate, domain test, hand-off, final decision, priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import policy as P
from skysieve.functions.numeric import argmax_label, clean_text, no_nan, to_number, top_margin
from skysieve.operators.guards import require_columns, require_unique
from skysieve.operators.ranking import PRIORITY_COLUMNS, score_priority
from skysieve.operators.skew import by_shuffle

OOD_STAGE_COLUMNS = (
    "source_id",
    "ood_decision",
    "ood_probability",
    "id_probability",
    "ood_threshold",
    "candidate_ood_threshold",
    "ood_threshold_name",
    "ood_threshold_metric",
    "ood_threshold_fit_scope",
    "ood_threshold_policy_version",
    "predicted_domain_target",
)
_DECISION_INPUT = (
    "source_id",
    "quality_state",
    "ood_decision",
    "coarse_predicted_label",
    "coarse_probability_max",
    "coarse_probability_margin",
    "refinement_predicted_label",
    "refinement_probability_max",
)


def tune_gate(df: DataFrame, policy: C.GatePolicy = C.GatePolicy()) -> DataFrame:
    """Re-run the gate: every row that is not `reject` restarts as pass.

    A present `has_missing_flame_features` column decides about FLAME; only when
    it is absent does a missing `radius_flame` count.
    """
    require_columns(df, ("quality_state",), "gate input")
    have = set(df.columns)

    def number(name):
        return to_number(F.col(name)) if name in have else F.lit(None).cast("double")

    if "has_missing_flame_features" in have:
        no_flame = F.coalesce(F.col("has_missing_flame_features").cast("boolean"), F.lit(False))
    elif "radius_flame" in have:
        no_flame = number("radius_flame").isNull()
    else:
        no_flame = F.lit(False)

    reason = P.gate_reason(number("ruwe"), number("parallax_over_error"), no_flame, policy)
    rejected = F.col("quality_state") == "reject"
    old = {
        c: F.col(c) if c in have else F.lit(None).cast("string")
        for c in ("quality_reason", "review_bucket")
    }
    return df.withColumn("_reason", reason).withColumns(
        {
            "quality_state": F.when(rejected, F.col("quality_state"))
            .when(F.col("_reason") == "pass", "pass")
            .otherwise("unknown"),
            **{c: F.when(rejected, old[c]).otherwise(F.col("_reason")) for c in old},
        }
    ).drop("_reason")


def score_domain(df: DataFrame, policy: C.OodPolicy) -> DataFrame:
    """Attach the ID/OOD state and the policy fields to rows with `ood_probability`."""
    require_columns(df, ("ood_probability",), "id/ood scored frame")
    p = F.col("ood_probability").cast("double")
    return df.withColumns(
        {
            "id_probability": F.col("id_probability") if "id_probability" in df.columns else 1.0 - p,
            "ood_threshold": F.lit(float(policy.threshold)),
            "candidate_ood_threshold": F.lit(policy.candidate_threshold).cast("double"),
            "ood_threshold_name": F.lit(policy.name),
            "ood_threshold_metric": F.lit(policy.metric),
            "ood_threshold_fit_scope": F.lit(policy.fit_scope),
            "ood_threshold_policy_version": F.lit(policy.version),
            "predicted_domain_target": F.when(p >= policy.threshold, "ood").otherwise("id"),
            "ood_decision": P.ood_state(p, policy),
        }
    )


def ood_stage(df: DataFrame) -> DataFrame:
    """The columns the domain stage hands on, as far as present."""
    have = set(df.columns)
    return df.select(*[c for c in OOD_STAGE_COLUMNS if c in have])


def summarise_probabilities(
    df: DataFrame, probabilities: dict[str, str], prefix: str
) -> DataFrame:
    """Top label, its probability and the margin to the second.

    `probabilities` maps class label to column name; labels are put in sorted
    order so that ties go to the first of them.
    """
    labels = sorted(probabilities)
    cols = [F.col(probabilities[x]).cast("double") for x in labels]
    return df.withColumns(
        {
            f"{prefix}_predicted_label": argmax_label(labels, cols),
            f"{prefix}_probability_max": F.array_max(F.array(*cols)),
            f"{prefix}_probability_margin": top_margin(cols),
        }
    )


def in_domain_rows(base: DataFrame, ood_scored: DataFrame) -> DataFrame:
    """Base rows whose id the domain stage called in-domain."""
    keep = ood_scored.where(F.col("ood_decision") == "in_domain").select("source_id")
    return base.join(by_shuffle(keep), "source_id", "left_semi")


def handed_family(policy: C.HandoffPolicy) -> Column:
    """The coarse class whose family model a row is handed to, NULL if it is not handed on."""
    reason = P.handoff_reason(
        F.lit("id"),
        F.col("coarse_predicted_label"),
        no_nan(F.col("coarse_probability_max")),
        no_nan(F.col("coarse_probability_margin")),
        policy,
    )
    return F.when(reason == "refinement_allowed", F.upper("coarse_predicted_label"))


def family_rows(
    base: DataFrame, coarse_scored: DataFrame, family: str, policy: C.HandoffPolicy
) -> DataFrame:
    """Base rows of one coarse class that pass the hand-off."""
    keep = coarse_scored.where(handed_family(policy) == family).select("source_id")
    return base.join(by_shuffle(keep), "source_id", "left_semi")


def decision_input(
    base: DataFrame,
    ood_scored: DataFrame,
    coarse_scored: DataFrame,
    refinement_scored: DataFrame | None = None,
    *,
    check: bool = True,
) -> DataFrame:
    """Base rows with the score frames of the stages beside them, one row per id."""
    frames = [
        (base, ("source_id", "quality_state"), "decision base frame"),
        (ood_scored, ("source_id", "ood_decision"), "ood scored frame"),
        (
            coarse_scored,
            (
                "source_id",
                "coarse_predicted_label",
                "coarse_probability_max",
                "coarse_probability_margin",
            ),
            "coarse scored frame",
        ),
    ]
    if refinement_scored is not None:
        frames.append(
            (
                refinement_scored,
                ("source_id", "refinement_predicted_label", "refinement_probability_max"),
                "refinement scored frame",
            )
        )
    for frame, needed, what in frames:
        require_columns(frame, needed, what)
        if check:
            require_unique(frame, what)
    out = base
    for frame, _, _ in frames[1:]:
        out = out.join(frame, "source_id", "left")
    if refinement_scored is None:
        out = out.withColumns(
            {
                "refinement_predicted_label": F.lit(None).cast("string"),
                "refinement_probability_max": F.lit(None).cast("double"),
                "refinement_probability_margin": F.lit(None).cast("double"),
                "refinement_family_name": F.lit(None).cast("string"),
            }
        )
    return out


def decide(df: DataFrame, policy: C.DecisionPolicy = C.DecisionPolicy()) -> DataFrame:
    """Final decision per row (D07): one reason column, everything else follows from it."""
    require_columns(df, _DECISION_INPUT, "final decision frame")
    cells = df.select(
        "source_id",
        F.lower(F.trim(F.col("quality_state").cast("string"))).alias("q"),
        F.lower(F.trim(F.col("ood_decision").cast("string"))).alias("o"),
        clean_text(F.col("coarse_predicted_label")).alias("c"),
        to_number(F.col("coarse_probability_max")).alias("cp"),
        to_number(F.col("coarse_probability_margin")).alias("cm"),
        clean_text(F.col("refinement_predicted_label")).alias("r"),
        to_number(F.col("refinement_probability_max")).alias("rp"),
    )
    candidate_state, candidate_reason = P.candidate_ood_outcome(policy)
    rules = [
        (F.col("q") == "reject", "quality_reject"),
        (F.col("q") == "unknown", "quality_unknown"),
        (F.col("o") == "ood", "hard_ood"),
        (F.col("o") == "candidate_ood", candidate_reason),
        (~F.col("o").eqNullSafe(F.lit("in_domain")), "unsupported_ood_state"),
        *P.handoff_rules(F.col("c"), F.col("cp"), F.col("cm"), policy.handoff),
        (F.col("r").isNull(), "refinement_label_missing"),
    ]
    if policy.min_refinement_confidence is not None:
        rules.append(
            (F.col("rp") < policy.min_refinement_confidence, "refinement_confidence_below_threshold")
        )
    reason = P.first_rule(rules, "refinement_accepted")
    id_reasons = (
        "coarse_class_not_enabled",
        "coarse_probability_below_threshold",
        "coarse_margin_below_threshold",
        "refinement_accepted",
    )
    refusals = ("refinement_label_missing", "refinement_confidence_below_threshold")
    why = F.col("final_decision_reason")
    refused = why.isin(*refusals)
    accepted = why == "refinement_accepted"
    stays_id = why.isin(*id_reasons)
    reached_id = why.isin(*id_reasons, *refusals)
    return cells.withColumn("final_decision_reason", reason).select(
        "source_id",
        F.when(stays_id, "id")
        .when(why == "hard_ood", "ood")
        .when(why == candidate_reason, candidate_state)
        .otherwise("unknown")
        .alias("final_domain_state"),
        F.col("q").alias("final_quality_state"),
        F.when(reached_id, F.col("c")).alias("final_coarse_class"),
        F.when(reached_id, F.col("cp")).alias("final_coarse_confidence"),
        F.when(accepted, F.col("r")).alias("final_refinement_label"),
        F.when(accepted, "accepted")
        .when(refused, "rejected_to_unknown")
        .otherwise("not_attempted")
        .alias("final_refinement_state"),
        F.when(accepted, F.col("rp")).alias("final_refinement_confidence"),
        why,
        F.lit(policy.version).alias("final_decision_policy_version"),
        F.lit(None).cast("string").alias("priority_state"),
    )


def priority_input(
    base: DataFrame,
    decisions: DataFrame,
    *,
    host_column: str = "host_similarity_score",
    check: bool = True,
) -> DataFrame:
    """Rows that may be ranked (in domain, passed, classed) with their base signals."""
    require_columns(base, ("source_id", host_column), "priority base frame")
    require_columns(
        decisions,
        ("source_id", "final_domain_state", "final_quality_state", "final_coarse_class"),
        "final decision frame",
    )
    if check:
        require_unique(base, "priority base frame")
        require_unique(decisions, "final decision frame")
    eligible = decisions.where(
        (F.lower("final_domain_state") == "id")
        & (F.lower("final_quality_state") == "pass")
        & F.col("final_coarse_class").isNotNull()
    ).select("source_id", F.upper(F.trim("final_coarse_class")).alias("spec_class"))
    extra = [c for c in C.RANKING_OPTIONAL_COLUMNS if c in base.columns]
    signals = by_shuffle(base.select("source_id", host_column, *extra))
    return eligible.join(signals, "source_id", "left").select(
        "source_id", "spec_class", host_column, *extra
    )


def merge_priority(decisions: DataFrame, ranking: DataFrame) -> DataFrame:
    """Put the ranking back beside the decisions; stale states are reset."""
    have = set(ranking.columns)
    extra = [c for c in PRIORITY_COLUMNS if c in have]
    ranked = ranking.select(F.col("source_id").cast("string").alias("_id"), *extra)
    left = decisions.drop("priority_state", *extra)
    label = F.col("priority_label") if "priority_label" in have else F.lit(None)
    return (
        left.join(by_shuffle(ranked), left["source_id"].cast("string") == ranked["_id"], "left")
        .drop("_id")
        .withColumn("priority_state", label.cast("string"))
    )


@dataclass(frozen=True)
class PriorityResult:
    inputs: DataFrame
    ranking: DataFrame
    decisions: DataFrame


def integrate_priority(
    base: DataFrame,
    decisions: DataFrame,
    *,
    host_column: str = "host_similarity_score",
    weights: C.PriorityWeights = C.PriorityWeights(),
    cuts: C.PriorityThresholds = C.PriorityThresholds(),
    check: bool = True,
) -> PriorityResult:
    """Priority input, its ranking and the decisions with priority merged in."""
    inputs = priority_input(base, decisions, host_column=host_column, check=check)
    ranking = score_priority(inputs, host_column=host_column, weights=weights, cuts=cuts)
    return PriorityResult(inputs, ranking, merge_priority(decisions, ranking))


def route(
    df: DataFrame,
    *,
    ood_policy: C.OodPolicy,
    policy: C.DecisionPolicy = C.DecisionPolicy(),
    class_probabilities: dict[str, str],
    refinement_label: str | None = None,
    refinement_probability: str | None = None,
) -> DataFrame:
    """Decision input from scores that already sit on the row.

    The stages only look at their own row, so results are carried forward as
    columns: coarse scores exist for in-domain rows only, refinement for rows that
    pass the hand-off. No stage has to be joined back by id.
    """
    staged = summarise_probabilities(score_domain(df, ood_policy), class_probabilities, "coarse")
    inside = F.col("ood_decision") == "in_domain"
    coarse = ["coarse_predicted_label", "coarse_probability_max", "coarse_probability_margin"]
    staged = staged.withColumns({c: F.when(inside, F.col(c)) for c in coarse})
    handed = (
        P.handoff_reason(F.lit("id"), *[F.col(c) for c in coarse], policy.handoff)
        == "refinement_allowed"
    )
    label = F.col(refinement_label) if refinement_label else F.lit(None)
    probability = F.col(refinement_probability) if refinement_probability else F.lit(None)
    return staged.withColumns(
        {
            "refinement_predicted_label": F.when(inside & handed, label.cast("string")),
            "refinement_probability_max": F.when(inside & handed, probability.cast("double")),
        }
    )
