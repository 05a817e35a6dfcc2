"""Quality, domain and hand-off rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysieve import contracts as C


def first_rule(rules, default=None) -> Column:
    """Label of the first rule that holds; NULL conditions do not hold."""
    out = None
    for holds, label in rules:
        out = F.when(holds, label) if out is None else out.when(holds, label)
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def gate_reason(ruwe: Column, snr: Column, no_flame: Column, policy: C.GatePolicy) -> Column:
    """First tuned rule a row breaks, or 'pass'. Inputs must be free of NaN."""
    rules = []
    if policy.max_ruwe is not None:
        rules.append((ruwe > policy.max_ruwe, "review_high_ruwe"))
    if policy.min_parallax_snr is not None:
        rules.append((snr < policy.min_parallax_snr, "review_low_parallax_snr"))
    if policy.require_flame:
        rules.append((no_flame, "review_missing_radius_flame"))
    return first_rule(rules, "pass")


def ood_state(probability: Column, policy: C.OodPolicy) -> Column:
    rules = [(probability >= policy.threshold, "ood")]
    if policy.candidate_threshold is not None:
        rules.append((probability >= policy.candidate_threshold, "candidate_ood"))
    return first_rule(rules, "in_domain")


def candidate_ood_outcome(policy: C.DecisionPolicy) -> tuple[str, str]:
    """Domain state and reason given to candidate-OOD rows."""
    if policy.keep_candidate_ood:
        return "candidate_ood", "candidate_ood"
    return "unknown", "candidate_ood_mapped_to_unknown"


def handoff_rules(coarse_class: Column, probability: Column, margin: Column, policy: C.HandoffPolicy):
    """Ordered (condition, reason) pairs that stop a coarse class from being refined.

    A threshold stops a row only when the value is there as well.
    """
    letter = F.upper(F.trim(coarse_class))
    enabled = F.coalesce(letter.isin(*policy.classes), F.lit(False)) if policy.classes else F.lit(False)
    rules = [(~enabled, "coarse_class_not_enabled")]
    if policy.min_probability is not None:
        rules.append((probability < policy.min_probability, "coarse_probability_below_threshold"))
    if policy.min_margin is not None:
        rules.append((margin < policy.min_margin, "coarse_margin_below_threshold"))
    return rules


def handoff_reason(
    domain: Column,
    coarse_class: Column,
    probability: Column,
    margin: Column,
    policy: C.HandoffPolicy = C.HandoffPolicy(),
) -> Column:
    """Why a row is not refined, or 'refinement_allowed'."""
    rules = handoff_rules(coarse_class, probability, margin, policy)
    outside = (~domain.eqNullSafe(F.lit("id")), "domain_not_id")
    return first_rule([outside, *rules], "refinement_allowed")
