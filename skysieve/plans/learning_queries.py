"""Registered queries: model training, scoring, saved runs and end-to-end flows.

Model fits differ between engines, so most of these have no SQL twin. Models and
protocol have the library's defaults, which are the benchmark settings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import evaluation as E
from skysieve.operators import layers as L
from skysieve.operators import learning as M
from skysieve.operators import sampling as SM
from skysieve.plans import bundles as B
from skysieve.plans import flows as FL
from skysieve.plans import stars as st
from skysieve.plans.evaluation_queries import downstream_ob, o_rows, train_ob
from skysieve.plans.frame_queries import coarse_frame, host_side, router_side
from skysieve.plans.registry import query
from skysieve.plans.twins import twin
from skysieve.session import materialise, scratch_path
from skysieve.sources import artifacts as A
from skysieve.sources import relations as R

TREES = M.ModelSpec("boosted_trees")
NETWORK = M.ModelSpec("network")
MIXTURE = M.ModelSpec("mixture")
PROTOCOL = C.Protocol()

_MODELS: dict[tuple, object] = {}


def once(spark, sf, name, make):
    """Fitted models are reused by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def coarse_model(spark, sf, spec=TREES):
    return once(spark, sf, f"coarse-{spec.kind}", lambda: M.fit(coarse_frame(spark, sf), C.COARSE_TASK, spec))


def ood_frame(spark, sf):
    df = st.stars(spark, sf).withColumn(
        "domain_target", F.expr("CASE WHEN parallax > 20 OR bp_rp > 3E0 THEN 'ood' ELSE 'id' END")
    )
    return FL.training_frame(df, C.OOD_TASK)


def ood_gate(spark, sf):
    return once(
        spark, sf, "ood-gate",
        lambda: M.fit_ood_gate(ood_frame(spark, sf), TREES, protocol=PROTOCOL),
    )


def host_data(spark, sf):
    return SM.host_field_dataset(host_side(spark, sf), router_side(spark, sf), ratio=1, check=False)


def host_model(spark, sf):
    return once(spark, sf, "host", lambda: M.fit(host_data(spark, sf), C.HOST_TASK, TREES))


def family_source(spark, sf):
    return st.stars(spark, sf).withColumn(
        "full_subclass_label", F.concat("spectral_class", F.col("spectral_subclass").cast("string"))
    )


def family_model(spark, sf):
    task = C.family_task("G")
    return once(spark, sf, "family-G", lambda: FL.train(family_source(spark, sf), task, TREES))


@query("m01_prepared_features")
def m01(spark, sf):
    df = coarse_frame(spark, sf).withColumn("radius_feature", F.col("radius_feature").cast("double"))
    fitted = M.preprocessor(C.COARSE_FEATURES, scale=True).fit(df)
    return fitted.transform(df).select("source_id", M.vector_to_array("_features").alias("features"))


def _probability_check(spark, sf, spec):
    model = coarse_model(spark, sf, spec)
    cols = [F.col(c) for c in model.probability_columns.values()]
    scored = M.score(coarse_frame(spark, sf), model)
    return scored.select(
        "source_id",
        F.round(sum(cols[1:], cols[0]), 6).alias("probability_sum"),
        F.col("predicted_spec_class").isin(*C.SPECTRAL_CLASSES).alias("known_label"),
    )


SUM_TWIN = "SELECT source_id, 1E0 AS probability_sum, true AS known_label FROM coarse_rows"


@query("m02_boosted_trees", twin(SUM_TWIN))
def m02(spark, sf):
    return _probability_check(spark, sf, TREES)


@query("m03_network", twin(SUM_TWIN))
def m03(spark, sf):
    return _probability_check(spark, sf, NETWORK)


@query("m04_mixture", twin(SUM_TWIN))
def m04(spark, sf):
    return _probability_check(spark, sf, MIXTURE)


@query("m05_host_score")
def m05(spark, sf):
    df = R.scoring_rows(st.stars(spark, sf), C.ROUTER_FEATURES)
    return M.score(df, host_model(spark, sf)).select("source_id", "host_similarity_score", "predicted_host_label")


@query("m06_trained_model")
def m06(spark, sf):
    model = coarse_model(spark, sf)
    return E.label_shares(
        coarse_frame(spark, sf).withColumn("split_name", F.lit("train")), model.task.target
    ).where("split_name = 'train'").withColumn("n_parts", F.lit(len(model.forest.base)))


@query("m07_scored_rows")
def m07(spark, sf):
    model = coarse_model(spark, sf)
    return M.score(coarse_frame(spark, sf), model).select(
        "source_id", "predicted_spec_class", "predicted_spec_class_confidence", *model.probability_columns.values()
    )


@query("m09_coarse_stage")
def m09(spark, sf):
    return M.score_coarse(coarse_frame(spark, sf), coarse_model(spark, sf))


@query("m10_family_stage")
def m10(spark, sf):
    rows = FL.training_frame(family_source(spark, sf), C.family_task("G"))
    return M.score_family(rows, family_model(spark, sf), "G")


@query("m11_boundary_scores")
def m11(spark, sf):
    return M.score_boundary(train_ob(spark, sf), coarse_model(spark, sf), "train_time").select(
        "source_id", "spectral_class", "coarse_predicted_label", "coarse_probability__O", "coarse_probability__B"
    )


@query("m12_calibrated_probability")
def m12(spark, sf):
    model = once(
        spark, sf, "isotonic",
        lambda: M.calibrated(ood_frame(spark, sf), C.OOD_TASK, "ood", TREES, method="isotonic", thresholds=None),
    )
    return model.apply(ood_frame(spark, sf), "ood_probability").select("source_id", "ood_probability")


@query("m14_ood_gate_run")
def m14(spark, sf):
    return ood_gate(spark, sf).metrics


@query("m18_permutation_importance")
def m18(spark, sf):
    rows = train_ob(spark, sf).withColumn("spec_class", F.col("spectral_class"))
    return M.permutation_importance(rows, coarse_model(spark, sf))


@query("m19_task_frames")
def m19(spark, sf):
    out = None
    for task in (C.STAGE_TASK, C.CLASS_TASK, C.COARSE_TASK, C.REFINEMENT_TASK, C.family_task("K")):
        src = family_source(spark, sf).drop("spec_subclass") if task.target != "spec_subclass" else family_source(spark, sf)
        part = FL.training_frame(src, task).agg(F.count("*").alias("n_rows")).withColumn("task", F.lit(task.name))
        out = part if out is None else out.unionByName(part)
    return out


def _benchmark(spark, sf):
    return once(
        spark, sf, "benchmark",
        lambda: M.benchmark(coarse_frame(spark, sf), C.COARSE_TASK, (TREES,), PROTOCOL),
    )


@query("e03_benchmark_metrics")
def e03(spark, sf):
    return _benchmark(spark, sf).metrics


@query("e03_benchmark_cv")
def e03_cv(spark, sf):
    return _benchmark(spark, sf).cv_summary.drop("fit_seconds", "cv_seconds", "total_seconds")


@query("e09_calibration_source")
def e09(spark, sf):
    scored = FL.host_calibration_source(host_side(spark, sf), router_side(spark, sf), TREES, protocol=PROTOCOL)
    return E.split_summary(scored, "host_label", "host")


@query("e13_domain_shift_review")
def e13(spark, sf):
    train = R.alias_features(coarse_frame(spark, sf), ("radius_feature",))
    tables = FL.domain_shift_review(train, downstream_ob(spark, sf), coarse_model(spark, sf))
    return tables["confusion"]


@query("e13_o_review")
def e13_o(spark, sf):
    run = B.saved_run(spark, sf)
    tables = FL.o_review(
        o_rows(spark, sf), coarse_model(spark, sf), {"final_decision": run.decisions, "decision_input": run.inputs}
    )
    return tables["predictions"]


@query("e14_prioritise")
def e14(spark, sf):
    frame = router_side(spark, sf)
    router = once(spark, sf, "router", lambda: M.fit(frame, C.CLASS_TASK, TREES))
    stage = once(spark, sf, "stage", lambda: M.fit(frame, C.STAGE_TASK, TREES))
    candidates = R.scoring_rows(st.stars(spark, sf), C.ROUTER_FEATURES)
    return FL.prioritise(candidates, router, stage, host_model(spark, sf)).select(
        "source_id", "spec_class", "priority_score", "priority_label"
    )


def decided(spark, sf):
    def make():
        gate = ood_gate(spark, sf)
        return FL.decide(
            spark,
            L.coarse_training_view(B.gated(spark, sf)),
            ood_model=gate.model,
            coarse_model=coarse_model(spark, sf),
            ood_policy=gate.policy,
            families={"G": family_model(spark, sf)},
            host_model=host_model(spark, sf),
            output=scratch_path(spark, "decide-run"),
        )

    return once(spark, sf, "decided", make)


@query("e15_decide_flow")
def e15(spark, sf):
    return A.load_run(spark, decided(spark, sf))["final_decision"].groupBy(
        "final_domain_state", "final_refinement_state", "priority_state"
    ).agg(F.count("*").alias("n_rows"))


@query("e16_score_flow")
def e16(spark, sf):
    path = FL.score_flow(
        R.scoring_rows(st.stars(spark, sf), C.ROUTER_FEATURES), host_model(spark, sf), scratch_path(spark, "scoring"), rank=True
    )
    _, ranking = A.load_scoring(spark, path)
    return ranking.groupBy("spec_class", "priority_label").agg(F.count("*").alias("n_rows"))


# --- saved tables ---------------------------------------------------------------------


def _saved(spark, sf):
    run = B.saved_run(spark, sf)
    tables = dict(zip(A.RUN_TABLES, (run.inputs, run.decisions, run.priority_input, run.ranking), strict=True))
    return A.save_run(tables, scratch_path(spark, "run"), "demo", {"policy": "test"})


@query(
    "s24_run_metadata",
    twin(
        """SELECT 'demo' AS pipeline_name, (SELECT count(*) FROM dinput) AS n_rows_input, (SELECT count(*) FROM decisions) AS n_rows_final_decision,
  (SELECT count(*) FROM pinput) AS n_rows_priority_input, (SELECT count(*) FROM ranking) AS n_rows_priority_ranking,
  (SELECT count(*) FROM decisions WHERE final_domain_state = 'id') AS n_id, (SELECT count(*) FROM ranking WHERE priority_label = 'high') AS n_high"""
    ),
)
def s24(spark, sf):
    return A.load_run(spark, _saved(spark, sf))["metadata"].select(
        "pipeline_name",
        "n_rows_input",
        "n_rows_final_decision",
        "n_rows_priority_input",
        "n_rows_priority_ranking",
        F.col("final_domain_distribution")["id"].alias("n_id"),
        F.col("priority_label_distribution")["high"].alias("n_high"),
    )


@query("s25_run_tables", twin("SELECT * FROM decisions"))
def s25(spark, sf):
    return A.load_run(spark, _saved(spark, sf))["final_decision"]


@query(
    "s26_threshold_policy",
    twin(
        """SELECT source_id, CASE WHEN ood_probability >= 9E-1 THEN 'ood' WHEN ood_probability >= 8E-1 THEN 'candidate_ood' ELSE 'in_domain' END AS ood_decision
  FROM stars"""
    ),
)
def s26(spark, sf):
    from skysieve.operators.decision import score_domain

    path = scratch_path(spark, "policy")
    A.save_policy(spark, B.OOD_POLICY, path, task="demo")
    rows = st.stars(spark, sf, "source_id", "ood_probability")
    return score_domain(rows, A.load_policy(spark, path)).select("source_id", "ood_decision")


@query("s27_reloaded_model", twin("SELECT source_id, true AS same_label FROM coarse_rows"))
def s27(spark, sf):
    model, path = coarse_model(spark, sf), scratch_path(spark, "model")
    A.save_model(spark, model, path, source="demo")
    again = A.load_model(spark, path)
    frame = coarse_frame(spark, sf)
    first = materialise(M.score(frame, model).select("source_id", "predicted_spec_class"), "scored")
    second = M.score(frame, again).select("source_id", F.col("predicted_spec_class").alias("second"))
    return first.join(second, "source_id").select(
        "source_id", (F.col("predicted_spec_class") == F.col("second")).alias("same_label")
    )


@query("s28_benchmark_tables")
def s28(spark, sf):
    path = scratch_path(spark, "benchmarks")
    for run_id in ("first", "second"):
        A.save_benchmark(_benchmark(spark, sf), path, run_id, C.COARSE_TASK.name)
    return A.load_benchmark(spark, path, "second")["target_distribution"]


@query(
    "s29_scoring_tables",
    twin("SELECT source_id, priority_label FROM allranked"),
)
def s29(spark, sf):
    from skysieve.operators.ranking import score_priority

    path = scratch_path(spark, "scoring")
    scored = st.stars(spark, sf)
    A.save_scoring(scored.select("source_id", "spec_class"), path, score_priority(scored), task_name="demo")
    return A.load_scoring(spark, path)[1].select("source_id", "priority_label")
