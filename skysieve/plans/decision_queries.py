"""Registered queries: gate, routing, decision and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import numeric as N
from skysieve.functions import policy as P
from skysieve.functions import scores as S
from skysieve.operators import decision as D
from skysieve.operators import layers as L
from skysieve.operators import ranking as R
from skysieve.plans import bundles as B
from skysieve.plans import stars as st
from skysieve.plans.registry import query
from skysieve.plans.twins import linear, twin, unit

GATE_OUT = (
    "source_id",
    *C.GATE_SIGNAL_COLUMNS,
    "in_ood_reference",
    "quality_state",
    "quality_reason",
    "ood_state",
    "ood_reason",
    "review_bucket",
)
GATE_LIST = ", ".join(GATE_OUT)


@query("d01_initial_gate", twin(f"SELECT {GATE_LIST} FROM gated"))
def d01(spark, sf):
    return B.gated(spark, sf).select(*GATE_OUT)


@query("d02_quality_gate", twin("SELECT source_id, quality_state, quality_reason, review_bucket FROM tuned"))
def d02(spark, sf):
    return B.tuned(spark, sf).select("source_id", "quality_state", "quality_reason", "review_bucket")


@query(
    "d02_quality_gate_relaxed",
    twin(
        """SELECT source_id, CASE WHEN why = 'pass' THEN 'pass' WHEN quality_state = 'reject' THEN 'reject' ELSE 'unknown' END
  AS quality_state, why AS quality_reason FROM (SELECT *, CASE WHEN quality_state = 'reject' THEN quality_reason
  WHEN ruwe > 1.6E0 THEN 'review_high_ruwe' WHEN parallax_over_error < 3E0 THEN 'review_low_parallax_snr'
  ELSE 'pass' END AS why FROM gated)"""
    ),
)
def d02_relaxed(spark, sf):
    return D.tune_gate(B.gated(spark, sf), C.GATE_VARIANTS[1]).select(
        "source_id", "quality_state", "quality_reason"
    )


@query(
    "d03_review_rows",
    twin(
        "SELECT source_id, quality_state, ood_state, review_bucket FROM gated "
        "WHERE quality_state <> 'pass' OR ood_state <> 'in_domain'"
    ),
)
def d03(spark, sf):
    return L.review_rows(B.gated(spark, sf)).select(
        "source_id", "quality_state", "ood_state", "review_bucket"
    )


@query(
    "d04_id_ood_gate",
    twin(
        """SELECT source_id, 1E0 - ood_probability AS id_probability, ood_probability, 9E-1 AS ood_threshold,
  8E-1 AS candidate_ood_threshold, 'tuned_threshold' AS ood_threshold_name, 'balanced_accuracy' AS ood_threshold_metric,
  'internal_cv' AS ood_threshold_fit_scope, 'id_ood_threshold_v1' AS ood_threshold_policy_version,
  CASE WHEN ood_probability >= 9E-1 THEN 'ood' ELSE 'id' END AS predicted_domain_target,
  CASE WHEN ood_probability >= 9E-1 THEN 'ood' WHEN ood_probability >= 8E-1 THEN 'candidate_ood' ELSE 'in_domain' END
    AS ood_decision FROM stars"""
    ),
)
def d04(spark, sf):
    return D.ood_stage(D.score_domain(st.stars(spark, sf, "source_id", "ood_probability"), B.OOD_POLICY))


@query(
    "d05_candidate_disposition",
    twin(
        """SELECT source_id, 'unknown' AS final_domain_state, 'candidate_ood_mapped_to_unknown' AS final_decision_reason
  FROM dinput WHERE quality_state = 'pass' AND ood_decision = 'candidate_ood'"""
    ),
)
def d05(spark, sf):
    strict = C.DecisionPolicy(keep_candidate_ood=False)
    return (
        D.decide(B.written_inputs(spark, sf), strict)
        .where(F.col("final_decision_reason") == P.candidate_ood_outcome(strict)[1])
        .select("source_id", "final_domain_state", "final_decision_reason")
    )


@query(
    "d06_refinement_handoff",
    twin(
        """SELECT source_id, CASE WHEN ood_decision <> 'in_domain' THEN 'domain_not_id'
  WHEN coarse_predicted_label = 'O' THEN 'coarse_class_not_enabled'
  WHEN coarse_probability_max < 6E-1 THEN 'coarse_probability_below_threshold'
  WHEN coarse_probability_margin < 5E-2 THEN 'coarse_margin_below_threshold'
  ELSE 'refinement_allowed' END AS reason FROM dinput"""
    ),
)
def d06(spark, sf):
    domain = F.when(F.col("ood_decision") == "in_domain", "id").otherwise(F.col("ood_decision"))
    rules = C.HandoffPolicy(min_probability=0.6, min_margin=0.05)
    return B.decision_inputs(spark, sf).select(
        "source_id",
        P.handoff_reason(
            domain,
            F.col("coarse_predicted_label"),
            F.col("coarse_probability_max"),
            F.col("coarse_probability_margin"),
            rules,
        ).alias("reason"),
    )


@query("d07_final_decision", twin("SELECT * FROM decisions"))
def d07(spark, sf):
    return D.decide(B.decision_inputs(spark, sf), B.DECISION_POLICY)


INPUT_OUT = (
    "source_id",
    "quality_state",
    "ood_decision",
    "id_probability",
    "coarse_predicted_label",
    "coarse_probability_max",
    "coarse_probability_margin",
    "refinement_predicted_label",
    "refinement_probability_max",
)


@query("d08_decision_input", twin(f"SELECT {', '.join(INPUT_OUT)} FROM dinput"))
def d08(spark, sf):
    return B.decision_inputs(spark, sf).select(*INPUT_OUT)


@query(
    "d09_priority_integration",
    twin(
        """SELECT d.* EXCLUDE (priority_state), r.priority_label AS priority_state, r.* EXCLUDE (source_id, spec_class, evolution_stage)
  FROM decisions d LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id"""
    ),
)
def d09(spark, sf):
    decisions = B.decision_run(spark, sf).decisions
    return D.integrate_priority(st.stars(spark, sf), decisions, check=False).decisions


@query(
    "d10_linear_scores",
    twin(
        f"""SELECT source_id, {linear('teff_gspphot', '3E3', '1E4')} AS rising,
  {linear('logg_gspphot', '1E0', '4E0', False)} AS falling, {unit('lum_flame / 2E1')} AS clamped,
  teff_gspphot IS NOT NULL AS available FROM stars"""
    ),
)
def d10(spark, sf):
    return st.stars(spark, sf, "source_id", "teff_gspphot", "logg_gspphot", "lum_flame").select(
        "source_id",
        N.linear_score(F.col("teff_gspphot"), 3000, 10000).alias("rising"),
        N.linear_score(F.col("logg_gspphot"), 1, 4, rising=False).alias("falling"),
        N.clamp01(F.col("lum_flame") / 20.0).alias("clamped"),
        F.col("teff_gspphot").isNotNull().alias("available"),
    )


@query("d11_brightness_distance", twin("SELECT source_id, brightness_score, distance_score FROM allranked"))
def d11(spark, sf):
    return st.stars(spark, sf, "source_id", "phot_g_mean_mag", "parallax").select(
        F.col("source_id").cast("string").alias("source_id"),
        S.brightness_score(F.col("phot_g_mean_mag")).alias("brightness_score"),
        S.distance_score(F.col("parallax")).alias("distance_score"),
    )


@query("d12_astrometry", twin("SELECT source_id, astrometry_score FROM allranked"))
def d12(spark, sf):
    return st.stars(spark, sf, "source_id", *C.QUALITY_FEATURES).select(
        F.col("source_id").cast("string").alias("source_id"),
        S.astrometry_score(*[F.col(c) for c in C.QUALITY_FEATURES]).alias("astrometry_score"),
    )


OBS_OUT = (
    "source_id",
    "brightness_score",
    "distance_score",
    "astrometry_score",
    "observability_score",
    "brightness_available",
    "distance_available",
    "astrometry_available",
    "observability_evidence_count",
)


@query("d13_observability", twin(f"SELECT {', '.join(OBS_OUT)} FROM allranked"))
def d13(spark, sf):
    return R.score_priority(st.stars(spark, sf)).select(*OBS_OUT)


@query(
    "d14_class_and_host_score",
    twin("SELECT source_id, class_priority_score, host_similarity_score FROM allranked"),
)
def d14(spark, sf):
    return R.score_priority(st.stars(spark, sf)).select(
        "source_id", "class_priority_score", "host_similarity_score"
    )


@query("d15_priority_ranking", twin("SELECT * FROM ranking"))
def d15(spark, sf):
    return R.rank_stars(B.decision_run(spark, sf).priority_input)


@query(
    "d16_priority_label",
    twin(
        """SELECT source_id, priority_score, CASE WHEN priority_score >= 85E-2 THEN 'high' WHEN priority_score >= 55E-2
  THEN 'medium' ELSE 'low' END AS priority_label FROM allranked"""
    ),
)
def d16(spark, sf):
    cuts = C.PriorityThresholds(high=0.85, medium=0.55)
    return R.score_priority(st.stars(spark, sf), cuts=cuts).select(
        "source_id", "priority_score", "priority_label"
    )


@query("d17_priority_reason", twin("SELECT source_id, priority_reason FROM allranked"))
def d17(spark, sf):
    return R.score_priority(st.stars(spark, sf)).select("source_id", "priority_reason")


@query(
    "d18_strict_number",
    twin(
        "SELECT o_orderkey AS source_id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN NULL "
        "ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS score FROM orders"
    ),
)
def d18(spark, sf):
    text = st.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_id"),
        F.expr(
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'NaN' "
            "ELSE CAST(o_totalprice AS STRING) END"
        ).alias("score"),
    )
    return text.select("source_id", N.strict_number(text, "score").alias("score"))


@query(
    "j08_decision_input_join",
    twin(
        """SELECT s.source_id, t.quality_state, o.ood_decision, c.label AS coarse_predicted_label,
  c.pmax AS coarse_probability_max, c.margin AS coarse_probability_margin,
  CASE WHEN c.source_id IS NOT NULL THEN s.refinement_label END AS refinement_predicted_label
  FROM stars s JOIN tuned t USING (source_id) LEFT JOIN dinput o USING (source_id)
  LEFT JOIN (SELECT * FROM coarse WHERE source_id IN (SELECT source_id FROM dinput WHERE ood_decision = 'in_domain')) c USING (source_id)"""
    ),
)
def j08(spark, sf):
    base = B.tuned(spark, sf).select("source_id", "quality_state", "ood_probability")
    ood = D.ood_stage(
        D.score_domain(st.stars(spark, sf, "source_id", "ood_probability"), B.OOD_POLICY)
    ).select("source_id", "ood_decision")
    inside = D.in_domain_rows(st.stars(spark, sf), ood)
    coarse = D.summarise_probabilities(inside, st.CLASS_PROBABILITIES, "coarse").select(
        "source_id", "coarse_predicted_label", "coarse_probability_max", "coarse_probability_margin"
    )
    refined = inside.select(
        "source_id",
        F.col("refinement_label").alias("refinement_predicted_label"),
        F.col("refinement_probability").alias("refinement_probability_max"),
    )
    return D.decision_input(base, ood, coarse, refined).select(
        "source_id",
        "quality_state",
        "ood_decision",
        "coarse_predicted_label",
        "coarse_probability_max",
        "coarse_probability_margin",
        "refinement_predicted_label",
    )


@query("j09_priority_input", twin("SELECT * FROM pinput"))
def j09(spark, sf):
    return B.decision_run(spark, sf).priority_input


@query(
    "j10_priority_merge",
    twin(
        """SELECT d.source_id, d.final_domain_state, r.priority_label AS priority_state, r.priority_score
  FROM decisions d LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id"""
    ),
)
def j10(spark, sf):
    run = B.decision_run(spark, sf)
    stale = run.decisions.withColumn("priority_state", F.lit("high"))
    return D.merge_priority(stale, run.ranking).select(
        "source_id", "final_domain_state", "priority_state", "priority_score"
    )


@query("j12_in_domain_rows", twin("SELECT source_id, ruwe FROM dinput WHERE ood_decision = 'in_domain'"))
def j12(spark, sf):
    base = st.stars(spark, sf, "source_id", "ruwe", "ood_probability")
    scored = D.score_domain(base, B.OOD_POLICY)
    return D.in_domain_rows(base, scored).select("source_id", "ruwe")


@query(
    "j13_family_rows",
    twin(
        "SELECT source_id, teff_gspphot FROM dinput WHERE ood_decision = 'in_domain' "
        "AND coarse_predicted_label = 'G' AND coarse_probability_max >= 6E-1"
    ),
)
def j13(spark, sf):
    scored = B.written_inputs(spark, sf)
    base = st.stars(spark, sf, "source_id", "teff_gspphot")
    return D.family_rows(base, scored, "G", B.DECISION_POLICY.handoff)


@query("k01_sort_by_id", twin("SELECT CAST(source_id AS VARCHAR) AS source_id, spec_class FROM stars"))
def k01(spark, sf):
    return R.sort_by_id(
        st.stars(spark, sf, "source_id", "spec_class").withColumn(
            "source_id", F.col("source_id").cast("string")
        )
    )


@query(
    "k02_ranking_order",
    twin(
        "SELECT row_number() OVER (ORDER BY priority_score DESC, host_similarity_score DESC, observability_score DESC, "
        "source_id) AS place, source_id, priority_score, host_similarity_score, observability_score FROM allranked"
    ),
)
def k02(spark, sf):
    return R.numbered_ranking(st.stars(spark, sf)).select(
        F.col("place").cast("long"), "source_id", "priority_score", "host_similarity_score", "observability_score"
    )


@query(
    "m08_probability_summary",
    twin(
        "SELECT source_id, label AS coarse_predicted_label, pmax AS coarse_probability_max, "
        "margin AS coarse_probability_margin FROM coarse"
    ),
)
def m08(spark, sf):
    return D.summarise_probabilities(st.stars(spark, sf), st.CLASS_PROBABILITIES, "coarse").select(
        "source_id", "coarse_predicted_label", "coarse_probability_max", "coarse_probability_margin"
    )


@query(
    "p24_ood_stage_columns",
    twin("SELECT source_id, ood_probability, 1E0 - ood_probability AS id_probability FROM stars"),
)
def p24(spark, sf):
    df = st.stars(spark, sf, "source_id", "ruwe", "ood_probability").withColumn(
        "id_probability", 1.0 - F.col("ood_probability")
    )
    return D.ood_stage(df)


@query(
    "u04_family_union",
    twin(
        """SELECT source_id, coarse_predicted_label AS refinement_family_name, refinement_label AS refinement_predicted_label
  FROM dinput WHERE ood_decision = 'in_domain' AND coarse_predicted_label <> 'O' AND coarse_probability_max >= 6E-1"""
    ),
)
def u04(spark, sf):
    scored = B.written_inputs(spark, sf)
    base = st.stars(spark, sf, "source_id", "refinement_label")
    parts = [
        D.family_rows(base, scored, family, B.DECISION_POLICY.handoff).select(
            "source_id",
            F.lit(family).alias("refinement_family_name"),
            F.col("refinement_label").alias("refinement_predicted_label"),
        )
        for family in C.REFINED_CLASSES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "flagship_priority_counts",
    twin(
        "SELECT spec_class, priority_label, count(*) AS n_rows, round(avg(priority_score), 6) AS mean_priority_score "
        "FROM ranking GROUP BY ALL"
    ),
)
def flagship(spark, sf):
    return (
        B.decision_run(spark, sf)
        .ranking.groupBy("spec_class", "priority_label")
        .agg(F.count("*").alias("n_rows"), F.round(F.avg("priority_score"), 6).alias("mean_priority_score"))
    )
