"""Frames that several registered queries start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skysieve import contracts as C
from skysieve.operators import decision as D
from skysieve.operators import layers as L
from skysieve.operators.ranking import score_priority
from skysieve.plans import stars as st
from skysieve.session import materialise

OOD_POLICY = C.OodPolicy(threshold=0.9, candidate_threshold=0.8)
DECISION_POLICY = C.DecisionPolicy(
    handoff=C.HandoffPolicy(min_probability=0.6), min_refinement_confidence=0.1
)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stars through the gate; their rows are marked while they hold the few columns of `orders`."""
    marked = L.mark_members(st.table(spark, sf_dir, "orders"), st.memberships(spark, sf_dir), st.K)
    return L.initial_gate(st.star_view(marked, keep=["in_ood_reference"]))


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tune_gate(gated(spark, sf_dir))


def decision_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route(
        tuned(spark, sf_dir),
        ood_policy=OOD_POLICY,
        policy=DECISION_POLICY,
        class_probabilities=st.CLASS_PROBABILITIES,
        refinement_label="refinement_label",
        refinement_probability="refinement_probability",
    )


@dataclass(frozen=True)
class Run:
    """The four tables of one decision run."""

    inputs: DataFrame
    decisions: DataFrame
    priority_input: DataFrame
    ranking: DataFrame


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def written_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision input as a written table, once per application.

    Four tables and every review start from these rows. Written to the shared
    folder they are computed once, survive lost executors, and later filters see
    plain columns instead of the whole score expressions.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialise(decision_inputs(spark, sf_dir), "decision-input")
    return _WRITTEN[key]


def decision_run(spark: SparkSession, sf_dir: str) -> Run:
    inputs = written_inputs(spark, sf_dir)
    decisions = D.decide(inputs, DECISION_POLICY)
    chosen = D.priority_input(st.stars(spark, sf_dir), decisions, check=False)
    return Run(inputs, decisions, chosen, score_priority(chosen))


_SAVED: dict[tuple[str, str], Run] = {}


def saved_run(spark: SparkSession, sf_dir: str) -> Run:
    """The four tables of a run as written tables, once per application: what reviews read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        run = decision_run(spark, sf_dir)
        decisions = materialise(run.decisions, "decisions")
        chosen = materialise(
            D.priority_input(st.stars(spark, sf_dir), decisions, check=False), "priority-input"
        )
        ranking = materialise(score_priority(chosen), "priority-ranking")
        _SAVED[key] = Run(run.inputs, decisions, chosen, ranking)
    return _SAVED[key]
