"""Frozen inputs of the gate, decision and priority rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import decision as D
from skysieve.operators import guards as G
from skysieve.operators import ranking as R

GATE = [
    (1, "pass", "pass", "pass", 1.1, 10.0, 1.0, False),
    (2, "unknown", "old", "old", 1.0, 7.0, None, True),
    (3, "unknown", "old", "old", 1.55, 10.0, 1.2, False),
    (4, "reject", "reject_missing_core_features", "reject_missing_core_features", 1.0, 9.0, 1.1, False),
]
GATE_SCHEMA = (
    "source_id long, quality_state string, quality_reason string, review_bucket string, ruwe double, "
    "parallax_over_error double, radius_flame double, has_missing_flame_features boolean"
)


def states(df):
    return {r.source_id: (r.quality_state, r.quality_reason) for r in df.collect()}


def test_gate_baseline(spark):
    out = states(D.tune_gate(spark.createDataFrame(GATE, GATE_SCHEMA)))
    assert out == {
        1: ("pass", "pass"),
        2: ("unknown", "review_missing_radius_flame"),
        3: ("unknown", "review_high_ruwe"),
        4: ("reject", "reject_missing_core_features"),
    }


def test_gate_without_flame_changes_only_one_row(spark):
    out = states(D.tune_gate(spark.createDataFrame(GATE, GATE_SCHEMA), C.GatePolicy(require_flame=False)))
    assert [out[i][0] for i in (1, 2, 3, 4)] == ["pass", "pass", "unknown", "reject"]


def test_gate_nan_is_missing_and_null_state_restarts(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan"), float("nan"), 1.0)],
        "source_id long, quality_state string, ruwe double, parallax_over_error double, radius_flame double",
    )
    assert states(D.tune_gate(df)) == {1: ("pass", "pass")}


def decision_input(spark, rows):
    return spark.createDataFrame(
        rows,
        "source_id long, quality_state string, ood_decision string, coarse_predicted_label string, coarse_probability_max double, "
        "coarse_probability_margin double, refinement_predicted_label string, refinement_probability_max double",
    )


def decided(spark, row, policy=C.DecisionPolicy()):
    r = D.decide(decision_input(spark, [(1, *row)]), policy).first()
    return r.final_domain_state, r.final_decision_reason, r.final_coarse_class, r.final_refinement_state


@pytest.mark.parametrize(
    "row, expected",
    [
        ((" Reject ", "in_domain", "G", 0.9, 0.5, "G2", 0.9), ("unknown", "quality_reject", None, "not_attempted")),
        (("unknown", "ood", "G", 0.9, 0.5, "G2", 0.9), ("unknown", "quality_unknown", None, "not_attempted")),
        ((None, None, "G", 0.9, 0.5, "G2", 0.9), ("unknown", "unsupported_ood_state", None, "not_attempted")),
        (("pass", "ood", "G", 0.9, 0.5, "G2", 0.9), ("ood", "hard_ood", None, "not_attempted")),
        (("pass", "candidate_ood", "G", 0.9, 0.5, "G2", 0.9), ("candidate_ood", "candidate_ood", None, "not_attempted")),
        (("pass", "in_domain", "O", 0.9, 0.5, None, None), ("id", "coarse_class_not_enabled", "O", "not_attempted")),
        (("pass", "in_domain", None, 0.9, 0.5, None, None), ("id", "coarse_class_not_enabled", None, "not_attempted")),
        (("pass", "in_domain", "F", 0.9, 0.5, " ", None), ("unknown", "refinement_label_missing", "F", "rejected_to_unknown")),
        (("pass", "in_domain", "f", 0.9, 0.5, "F5", None), ("id", "refinement_accepted", "f", "accepted")),
    ],
)
def test_decision_rules(spark, row, expected):
    assert decided(spark, row) == expected


def test_handoff_threshold_needs_a_value(spark):
    policy = C.DecisionPolicy(handoff=C.HandoffPolicy(min_probability=0.99))
    assert decided(spark, ("pass", "in_domain", "G", 0.9, 0.5, "G2", 0.9), policy)[:2] == (
        "id",
        "coarse_probability_below_threshold",
    )
    assert decided(spark, ("pass", "in_domain", "G", None, None, "G2", 0.9), policy)[1] == "refinement_accepted"


def test_refinement_confidence(spark):
    policy = C.DecisionPolicy(min_refinement_confidence=0.5)
    assert decided(spark, ("pass", "in_domain", "G", 0.9, 0.5, "G2", 0.4), policy) == (
        "unknown",
        "refinement_confidence_below_threshold",
        "G",
        "rejected_to_unknown",
    )


def test_priority_eligibility_and_merge(spark):
    decisions = spark.createDataFrame(
        [(1, "id", "pass", "G", "high"), (2, "candidate_ood", "pass", "K", "high"), (3, "unknown", "reject", None, "low"), (4, "id", "pass", "A", "high")],
        "source_id long, final_domain_state string, final_quality_state string, final_coarse_class string, priority_state string",
    )
    base = spark.createDataFrame(
        [(i, 0.9, "dwarf", 12.0, 11.0, 15.0, 1.05, 0.9) for i in (1, 2, 3, 4)],
        "source_id long, host_similarity_score double, evolution_stage string, parallax double, phot_g_mean_mag double, "
        "parallax_over_error double, ruwe double, validation_factor double",
    )
    out = D.integrate_priority(base, decisions)
    assert sorted(r.source_id for r in out.inputs.collect()) == [1, 4]
    merged = {r.source_id: (r.priority_state, r.priority_score) for r in out.decisions.collect()}
    assert merged[2] == (None, None) and merged[3] == (None, None)
    assert merged[1][0] == "high" and merged[4][0] == "low" and merged[4][1] == 0.34


def test_priority_score_by_hand(spark):
    df = spark.createDataFrame(
        [("1", "g", "giant", "0.8", 13.0, 11.0, None, None, None), ("2", "x", None, None, None, None, None, None, None)],
        "source_id string, spec_class string, evolution_stage string, host_similarity_score string, phot_g_mean_mag double, "
        "parallax double, parallax_over_error double, ruwe double, validation_factor double",
    )
    a, b = R.score_priority(df).orderBy("source_id").collect()
    assert a.class_priority_score == 0.85 and a.brightness_score == 0.5 and a.distance_score == 0.5
    assert a.astrometry_score == 0.5 and a.observability_evidence_count == 2
    assert abs(a.priority_score - (0.2 * 0.85 + 0.45 * 0.8 + 0.35 * 0.5)) < 1e-12
    said = C.PRIORITY_REASONS
    codes = ("evolved_stage_penalty", "strong_host_signal", "observability_with_partial_inputs")
    assert a.priority_reason == "; ".join(said[c] for c in codes)
    assert b.class_priority_score == 0.5 and b.host_similarity_score == 0.5
    assert b.priority_reason == said["observability_without_inputs"]


def test_ids_sort_as_text(spark):
    df = spark.createDataFrame([(9,), (10,), (2,)], "source_id long")
    assert [r.source_id for r in R.sort_by_id(df).collect()] == [10, 2, 9]


def test_score_text_is_strict(spark):
    df = spark.createDataFrame([("1", "G", "high")], "source_id string, spec_class string, host_similarity_score string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.score_priority(df).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, "G"), (1, "Q")], "source_id long, spec_class string").withColumn(
        "evolution_stage", F.lit("dwarf")
    )
    with pytest.raises(ValueError, match="missing required columns: ruwe"):
        G.require_columns(df, ("source_id", "ruwe"), "frame")
    with pytest.raises(ValueError, match="Sample ids: 1"):
        G.require_unique(df, "frame")
    with pytest.raises(ValueError, match="unsupported spec_class values: Q"):
        G.require_no_violations(G.label_violations(df), "frame")
    with pytest.raises(ValueError, match="a: y; b: x, z"):
        G.require_relations({"b": (df, ("x", "z")), "a": (df, ("y", "source_id"))})


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.GatePolicy(max_ruwe=0.0),
        lambda: C.OodPolicy(0.5, 0.6),
        lambda: C.PriorityWeights(0.5, 0.5, 0.5),
        lambda: C.PriorityThresholds(high=0.4, medium=0.5),
        lambda: C.HandoffPolicy(min_margin=1.5),
        lambda: C.Protocol(folds=1),
        lambda: C.require_family("O"),
    ],
)
def test_policies_reject_bad_values(make):
    with pytest.raises(ValueError):
        make()
