"""End-to-end flows: train, decide, score, prioritise, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.labels import family_label
from skysieve.operators import boundary as O
from skysieve.operators import decision as D
from skysieve.operators import frames as FR
from skysieve.operators import learning as M
from skysieve.operators import sampling as SM
from skysieve.operators.ranking import score_priority
from skysieve.session import materialise
from skysieve.sources import artifacts as A
from skysieve.sources import relations as R


def adopt_router_predictions(
    df: DataFrame, class_target: str = "spec_class", stage_target: str = "evolution_stage"
) -> DataFrame:
    """Router predictions take the place of the label columns before ranking."""
    return df.withColumns(
        {
            "spec_class": F.col(f"predicted_{class_target}").cast("string"),
            "evolution_stage": F.col(f"predicted_{stage_target}").cast("string"),
        }
    )


# --- training -------------------------------------------------------------------------


def training_frame(source: DataFrame, task: C.Task, *, hosts: DataFrame | None = None, limit=None) -> DataFrame:
    """Scan, prepare and check the frame of a task."""
    if task.name == C.HOST_TASK.name:
        if hosts is None:
            raise ValueError("the host task needs a host table")
        frame = SM.host_field_dataset(
            FR.host_frame(R.host_rows(hosts, limit)), FR.router_frame(R.router_rows(source, limit))
        )
    elif task.name in (C.STAGE_TASK.name, C.CLASS_TASK.name, C.SUBCLASS_TASK.name):
        frame = FR.router_frame(R.router_rows(source, limit))
    elif task.name == C.COARSE_TASK.name:
        frame = R.alias_features(FR.coarse_frame(R.coarse_rows(source, limit)), ("radius_feature",))
    elif task.name == C.OOD_TASK.name:
        frame = FR.ood_frame(R.ood_rows(source, limit))
    elif task.name == C.REFINEMENT_TASK.name:
        frame = FR.refinement_frame(R.refinement_rows(source, limit))
    else:
        family = task.name.removeprefix("gaia_mk_refinement_")[0].upper()
        frame = FR.family_frame(R.family_rows(source, family, limit), family)
    return FR.task_ready(frame, task.target, task.name)


def train(source: DataFrame, task: C.Task, spec: M.ModelSpec = M.ModelSpec(), *, hosts=None, limit=None):
    return M.fit(training_frame(source, task, hosts=hosts, limit=limit), task, spec)


def run_benchmark(
    source: DataFrame, task: C.Task, specs=(M.ModelSpec(),), protocol: C.Protocol = C.Protocol(), *, hosts=None
):
    return M.benchmark(training_frame(source, task, hosts=hosts), task, specs, protocol)


# --- decide ---------------------------------------------------------------------------


def decide(
    spark: SparkSession,
    base: DataFrame,
    *,
    ood_model: M.CalibratedModel,
    coarse_model: M.StarModel,
    ood_policy: C.OodPolicy,
    output: str,
    families: dict[str, M.StarModel] | None = None,
    host_model: M.StarModel | None = None,
    gate: C.GatePolicy = C.GatePolicy(),
    policy: C.DecisionPolicy = C.DecisionPolicy(),
    name: str = "decide",
) -> str:
    """Gate, domain, coarse class, subclass, decision and ranking; saves the run.

    The stages add columns to the same row. The scored input is written once and
    every later table is derived from it.
    """
    features = C.ordered_union(
        ood_model.model.task.features,
        coarse_model.task.features,
        *(m.task.features for m in (families or {}).values()),
        host_model.task.features if host_model else (),
    )
    rows = D.tune_gate(R.alias_features(base, features), gate)
    rows = D.score_domain(ood_model.apply(rows, "ood_probability"), ood_policy)
    rows = D.summarise_probabilities(
        M.with_probabilities(rows, coarse_model), coarse_model.probability_columns, "coarse"
    ).drop(*coarse_model.probability_columns.values())
    inside = F.col("ood_decision") == "in_domain"
    coarse = ["coarse_predicted_label", "coarse_probability_max", "coarse_probability_margin"]
    rows = rows.withColumns({c: F.when(inside, F.col(c)) for c in coarse})
    if host_model:
        rows = M.score(rows, host_model).drop(*host_model.probability_columns.values())
    scored = materialise(rows, "decide-scored")
    inputs = refine(scored, families or {}, policy)
    if families:
        inputs = materialise(inputs, "decide-refined")
    decisions = D.decide(inputs, policy)
    if host_model:
        result = D.integrate_priority(scored, decisions)
        tables = (inputs, result.decisions, result.inputs, result.ranking)
    else:
        empty = decisions.select("source_id").limit(0)
        tables = (inputs, decisions, empty, empty)
    return A.save_run(dict(zip(A.RUN_TABLES, tables, strict=True)), output, name)


def _without_refinement(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "refinement_predicted_label": F.lit(None).cast("string"),
            "refinement_probability_max": F.lit(None).cast("double"),
            "refinement_probability_margin": F.lit(None).cast("double"),
            "refinement_family_name": F.lit(None).cast("string"),
        }
    )


def refine(scored: DataFrame, families: dict[str, M.StarModel], policy: C.DecisionPolicy) -> DataFrame:
    """Each row through the family model it is handed to, if there is one (U04); rows are filtered, never joined."""
    if not families:
        return _without_refinement(scored)
    rows = scored.withColumn("_family", D.handed_family(policy.handoff))
    rest = rows.where(~F.coalesce(F.col("_family").isin(*families), F.lit(False)))
    out = _without_refinement(rest).withColumn("refinement_model_name", F.lit(None).cast("string"))
    for family, model in families.items():
        part = M.with_probabilities(rows.where(F.col("_family") == family), model)
        part = D.summarise_probabilities(part, model.probability_columns, "refinement").withColumns(
            {
                "refinement_predicted_label": family_label(F.col("refinement_predicted_label"), family),
                "refinement_family_name": F.lit(family),
                "refinement_model_name": F.lit(model.spec.kind),
            }
        )
        out = out.unionByName(part.select(*out.columns))
    return out.drop("_family")


# --- score and prioritise -------------------------------------------------------------


def score_flow(df: DataFrame, model: M.StarModel, output: str, *, rank: bool = False) -> str:
    """Score a table and, when asked, rank it."""
    scored = materialise(M.score(R.alias_features(df, model.task.features), model), "scored")
    ranking = score_priority(scored) if rank else None
    A.save_scoring(scored, output, ranking, task_name=model.task.name, model_name=model.spec.kind)
    return output


def prioritise(candidates: DataFrame, router: M.StarModel, stage: M.StarModel, host: M.StarModel) -> DataFrame:
    """Candidates through router, stage and host models, then ranked."""
    scored = M.spread(candidates)
    for model in (router, stage, host):
        scored = M.score(scored, model).drop(*model.probability_columns.values())
    return score_priority(materialise(adopt_router_predictions(scored), "prioritise-scored"))


# --- review sources -------------------------------------------------------------------


def host_calibration_source(
    hosts: DataFrame, router: DataFrame, spec: M.ModelSpec = M.ModelSpec(), *, ratio: int = 1,
    protocol: C.Protocol = C.Protocol(),
) -> DataFrame:
    """Host/field rows of both splits scored by a model fitted on the train part."""
    data = SM.host_field_dataset(hosts, router, ratio=ratio)
    split = materialise(SM.stratified_split(data, C.HOST_TASK.strata, protocol), "host-split")
    model = M.fit(split.where("split_name = 'train'"), C.HOST_TASK, spec)
    return M.score(split, model)


def domain_shift_review(train: DataFrame, downstream: DataFrame, model: M.StarModel) -> dict[str, DataFrame]:
    """All tables of the O/B domain-shift review."""
    boundary = O.both_domains(O.train_boundary(train), O.downstream_boundary(downstream))
    scored = M.score_boundary(boundary, model)
    by_class = ["domain_name", "spectral_class"]
    return {
        "boundary": boundary,
        "scored": scored,
        "confusion": O.confusion_shares(scored),
        "probabilities": O.probability_summary(scored),
        "physics": O.physics_summary(boundary, by_class),
        "missing": O.missing_shares(boundary, by_class),
        "shift_auc": O.domain_shift_auc(boundary),
    }


def o_review(source: DataFrame, model: M.StarModel, run: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Class O rows: quality, predictions and fate in a decision run."""
    passed = O.scoring_frame(source.where("quality_state = 'pass'"))
    scored = M.score_boundary(passed, model)
    return {
        "scored": scored,
        "predictions": O.prediction_levels(scored),
        "physics": O.physics_summary(
            scored, ["coarse_predicted_label"], ("teff_gspphot", "logg_gspphot", "bp_rp", "radius_flame")
        ),
        "non_o": O.confident_errors(scored, O.not_called("O")),
        "outcomes": O.final_outcomes(
            source.select("source_id", "spectral_class", "teff_gspphot"), run["final_decision"], run["decision_input"]
        ),
        "hot": O.hot_membership(source),
    }
