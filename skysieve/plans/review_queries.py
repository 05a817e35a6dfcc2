"""Registered queries: reviews of decision runs, gates, priorities, hosts and scoring runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import reviews as V
from skysieve.operators.distributions import distribution
from skysieve.operators.evaluation import label_shares
from skysieve.operators.ranking import score_priority
from skysieve.plans import bundles as B
from skysieve.plans import stars as st
from skysieve.plans.frame_queries import coarse_split, host_contract_side
from skysieve.plans.registry import query
from skysieve.plans.twins import VIEWS, dist_sql, twin


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def q50(column: str) -> str:
    return f"round(quantile_cont({column}, 5E-1), 6)"


def run(spark, sf):
    return B.saved_run(spark, sf)


# --- distributions --------------------------------------------------------------------


@query("a03_distribution", twin(dist_sql("stars", "luminosity_class")))
def a03(spark, sf):
    return distribution(st.stars(spark, sf, "luminosity_class"), "luminosity_class")


_RUN_DISTRIBUTIONS = {
    "a04_domain_distribution": ("decisions", "final_domain_state", None, None),
    "a04_quality_distribution": ("decisions", "final_quality_state", None, None),
    "a04_refinement_distribution": ("decisions", "final_refinement_state", None, None),
    "a04_decision_reasons": ("decisions", "final_decision_reason", 20, None),
    "a04_quality_reasons": ("inputs", "quality_reason", 20, None),
    "a04_review_buckets": ("inputs", "review_bucket", 20, None),
    "a06_priority_labels": ("ranking", "priority_label", None, None),
    "a06_priority_reasons": ("ranking", "priority_reason", 20, None),
    "a06_coarse_classes": ("decisions", "final_coarse_class", 20, "final_domain_state = 'id'"),
    "a06_refinement_labels": ("decisions", "final_refinement_label", 20, "final_domain_state = 'id'"),
}


def _register_run_distribution(name, table, column, top, where):
    view = {"inputs": "dinput"}.get(table, table)

    @query(name, twin(dist_sql(view, column, top=top, where=where or "true")))
    def fn(spark, sf):
        df = getattr(run(spark, sf), table)
        return distribution(df.where(where) if where else df, column, top_n=top)


for _name, _spec in _RUN_DISTRIBUTIONS.items():
    _register_run_distribution(_name, *_spec)


def _register_gate_distribution(name, column, top):
    @query(name, twin(dist_sql("gated", column, top=top)))
    def fn(spark, sf):
        return distribution(B.gated(spark, sf), column, top_n=top)


for _name, _column, _top in (
    ("a05_quality_states", "quality_state", None),
    ("a05_ood_states", "ood_state", None),
    ("a05_quality_reasons", "quality_reason", 20),
    ("a05_review_buckets", "review_bucket", 20),
):
    _register_gate_distribution(_name, _column, _top)

VIEWS["cohort"] = """
SELECT r.*, d.final_domain_state, d.final_coarse_class, d.final_refinement_label, i.teff_gspphot, i.logg_gspphot, i.mh_gspphot, i.parallax,
  i.parallax_over_error, i.ruwe, i.phot_g_mean_mag, i.radius_flame, i.lum_flame
FROM ranking r LEFT JOIN decisions d ON CAST(d.source_id AS VARCHAR) = r.source_id LEFT JOIN stars i ON CAST(i.source_id AS VARCHAR) = r.source_id
WHERE priority_label = 'high'"""


def cohort(spark, sf):
    r = run(spark, sf)
    return V.high_cohort(r.ranking, r.decisions, r.inputs)


@query("a07_cohort_classes", twin(dist_sql("cohort", "final_coarse_class", top=10)))
def a07(spark, sf):
    return distribution(cohort(spark, sf), "final_coarse_class", top_n=10)


@query("a07_cohort_labels", twin(dist_sql("cohort", "final_refinement_label", top=10)))
def a07_labels(spark, sf):
    return distribution(cohort(spark, sf), "final_refinement_label", top_n=10)


@query("a08_prediction_distribution", twin(dist_sql("coarse", "label", "prediction_label")))
def a08(spark, sf):
    return distribution(
        B.written_inputs(spark, sf).select(
            F.expr("array_max(array(struct(p_A p, -1 o, 'A' l), struct(p_B p, -2 o, 'B' l), struct(p_F p, -3 o, 'F' l), "
                   "struct(p_G p, -4 o, 'G' l), struct(p_K p, -5 o, 'K' l), struct(p_M p, -6 o, 'M' l), struct(p_O p, -7 o, 'O' l))).l").alias("predicted")
        ),
        "predicted",
        "prediction_label",
    )


@query(
    "a09_browser_distribution",
    twin(
        "SELECT priority_label, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share FROM decisions d "
        "LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id WHERE trim(priority_label) <> '' GROUP BY 1"
    ),
)
def a09(spark, sf):
    r = run(spark, sf)
    browser = V.run_browser(r.decisions, r.ranking, r.priority_input, r.inputs)
    return distribution(browser, "priority_label", drop_blank=True)


@query(
    "a10_domain_quality_crosstab",
    twin(
        """SELECT final_domain_state, count(*) FILTER (WHERE final_quality_state = 'pass') AS pass, count(*) FILTER (WHERE final_quality_state = 'unknown')
  AS unknown, count(*) FILTER (WHERE final_quality_state = 'reject') AS reject FROM decisions GROUP BY 1"""
    ),
)
def a10(spark, sf):
    return V.domain_quality_crosstab(run(spark, sf).decisions)


@query(
    "a10_variant_transitions",
    twin(
        """SELECT quality_state, count(*) FILTER (WHERE v = 'pass') AS pass, count(*) FILTER (WHERE v = 'unknown') AS unknown,
  count(*) FILTER (WHERE v = 'reject') AS reject FROM (SELECT quality_state, CASE WHEN quality_state = 'reject' THEN 'reject'
  WHEN ruwe > 1.2E0 OR parallax_over_error < 7E0 OR has_missing_flame_features THEN 'unknown' ELSE 'pass' END AS v FROM gated) GROUP BY 1"""
    ),
)
def a10_variant(spark, sf):
    return V.gate_variant_transitions(B.gated(spark, sf), C.GATE_VARIANTS[2])


# --- gate -----------------------------------------------------------------------------


@query(
    "a11_gate_summary",
    twin(
        """SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_unique_source_id, count(*) FILTER (WHERE quality_state = 'pass') AS n_pass_rows,
  count(*) FILTER (WHERE quality_state = 'unknown') AS n_unknown_rows, count(*) FILTER (WHERE quality_state = 'reject') AS n_reject_rows,
  count(*) FILTER (WHERE ood_state = 'in_domain') AS n_in_domain_rows, count(*) FILTER (WHERE ood_state = 'candidate_ood') AS n_candidate_ood_rows,
  count(*) FILTER (WHERE ood_state = 'ood') AS n_ood_rows FROM gated"""
    ),
)
def a11(spark, sf):
    return V.gate_summary(B.gated(spark, sf))


_SIGNALS = " UNION ALL ".join(
    f"""SELECT '{c}' AS signal_name, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n_rows_true, count(*) FILTER (WHERE {c}) / count(*) AS share_true,
  count(*) FILTER (WHERE {c} AND quality_state = 'pass') AS n_pass_true, count(*) FILTER (WHERE {c} AND quality_state = 'unknown') AS n_unknown_true,
  count(*) FILTER (WHERE {c} AND quality_state = 'reject') AS n_reject_true, count(*) FILTER (WHERE {c} AND ood_state = 'in_domain') AS n_in_domain_true,
  count(*) FILTER (WHERE {c} AND ood_state = 'candidate_ood') AS n_candidate_ood_true, count(*) FILTER (WHERE {c} AND ood_state = 'ood') AS n_ood_true
  FROM gated"""
    for c in C.GATE_SIGNAL_COLUMNS
)


@query("a12_gate_signals", twin(_SIGNALS))
def a12(spark, sf):
    return V.gate_signals(B.gated(spark, sf))


@query(
    "a13_run_summary",
    twin(
        """SELECT *, coalesce(high_priority_count / nullif(ranked_count, 0), 0E0) AS high_priority_share FROM (
  SELECT count(*) AS total_objects, count(DISTINCT source_id) AS n_unique_source_id, count(*) FILTER (WHERE final_domain_state = 'id') AS id_count,
  count(*) FILTER (WHERE final_domain_state = 'unknown') AS unknown_count, count(*) FILTER (WHERE final_domain_state = 'ood') AS ood_count FROM decisions),
  (SELECT count(*) AS ranked_count, count(*) FILTER (WHERE priority_label = 'high') AS high_priority_count,
  count(*) FILTER (WHERE priority_label = 'medium') AS medium_priority_count, count(*) FILTER (WHERE priority_label = 'low') AS low_priority_count FROM ranking)"""
    ),
)
def a13(spark, sf):
    r = run(spark, sf)
    return V.run_summary(r.decisions, r.ranking)


@query(
    "a14_host_status",
    twin(
        """SELECT true AS host_signal_available, (SELECT count(*) FROM pinput) AS priority_input_rows, (SELECT count(*) FROM ranking) AS priority_output_rows,
  'host_signal_ranked' AS status_note"""
    ),
)
def a14(spark, sf):
    r = run(spark, sf)
    return V.host_signal_status(r.inputs, r.priority_input, r.ranking)


_STATE = " UNION ALL ".join(
    f"SELECT final_domain_state AS group_value, '{c}' AS metric_name, round(avg(i.{c}), 6) AS mean_value, {q50('i.' + c)} AS median_value, "
    f"count(i.{c}) AS n_rows FROM dinput i JOIN decisions d USING (source_id) WHERE i.{c} IS NOT NULL GROUP BY 1"
    for c in V.STATE_METRICS
)


@query("a15_state_metrics", twin(_STATE))
def a15(spark, sf):
    r = run(spark, sf)
    return rounded(V.state_metrics(r.inputs, r.decisions), "mean_value", "median_value")


_Q = " UNION ALL ".join(
    f"SELECT CAST({q!r} AS DOUBLE) AS quantile, "
    + ", ".join(f"round(quantile_cont({c}, {q!r}), 6) AS {c}" for c in V.PRIORITY_COMPONENTS)
    + " FROM ranking"
    for q in V.QUANTILES
)


@query("a16_component_quantiles", twin(_Q))
def a16(spark, sf):
    return rounded(V.component_quantiles(run(spark, sf).ranking), *V.PRIORITY_COMPONENTS)


@query(
    "a17_score_by_class",
    twin(
        f"""SELECT spec_class AS final_coarse_class, count(*) AS n_rows, round(avg(priority_score), 6) AS mean_priority_score,
  {q50('priority_score')} AS median_priority_score, round(max(priority_score), 6) AS max_priority_score, round(min(priority_score), 6) AS min_priority_score
  FROM ranking GROUP BY 1"""
    ),
)
def a17(spark, sf):
    r = run(spark, sf)
    names = [f"{x}_priority_score" for x in ("mean", "median", "max", "min")]
    return rounded(V.score_by_class(r.ranking, r.decisions), *names)


_COHORT = ("priority_score", "host_similarity_score", "observability_score", "parallax_over_error", "ruwe", "phot_g_mean_mag")


@query(
    "a18_cohort_summary",
    twin(
        "SELECT count(*) AS n_rows, count(*) / greatest((SELECT count(*) FROM ranking), 1) AS share_priority_ranking, "
        "count(*) / greatest((SELECT count(*) FROM decisions WHERE final_domain_state = 'id'), 1) AS share_final_id, "
        + ", ".join(f"{q50(c)} AS median_{c}" for c in _COHORT)
        + " FROM cohort"
    ),
)
def a18(spark, sf):
    r = run(spark, sf)
    out = V.cohort_summary(cohort(spark, sf), r.ranking, r.decisions)
    return rounded(out, *[f"median_{c}" for c in _COHORT])


_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS metric_name, round(quantile_cont({c}, 25E-2), 6) AS p25_value, {q50(c)} AS median_value, "
    f"round(quantile_cont({c}, 75E-2), 6) AS p75_value FROM cohort HAVING count({c}) > 0"
    for c in (*V.PRIORITY_COMPONENTS, *V.COHORT_PHYSICS)
)


@query("a19_cohort_components", twin(_PARTS))
def a19(spark, sf):
    return rounded(V.cohort_components(cohort(spark, sf)), "p25_value", "median_value", "p75_value")


_VARIANTS = " UNION ALL ".join(
    f"""SELECT '{v.name}' AS variant_name, CAST({v.high} AS DOUBLE) AS high_min, CAST({v.medium} AS DOUBLE) AS medium_min, count(*) AS n_rows,
  count(*) FILTER (WHERE priority_score >= {v.high}) AS n_high,
  count(*) FILTER (WHERE priority_score < {v.high} AND priority_score >= {v.medium}) AS n_medium, count(*) FILTER (WHERE priority_score < {v.medium}) AS n_low,
  count(*) FILTER (WHERE priority_label <> CASE WHEN priority_score >= {v.high} THEN 'high' WHEN priority_score >= {v.medium} THEN 'medium' ELSE 'low' END)
  AS n_changed_from_baseline FROM ranking"""
    for v in V.LABEL_VARIANTS
)


@query(
    "a20_threshold_variants",
    twin(
        f"""SELECT *, n_high / n_rows AS share_high, n_medium / n_rows AS share_medium, n_low / n_rows AS share_low,
  n_changed_from_baseline / n_rows AS share_changed_from_baseline FROM ({_VARIANTS})"""
    ),
)
def a20(spark, sf):
    return V.label_variant_summary(run(spark, sf).ranking)


_STRICT = "CASE WHEN priority_score >= 85E-2 THEN 'high' WHEN priority_score >= 55E-2 THEN 'medium' ELSE 'low' END"


@query(
    "a21_label_transitions",
    twin(
        f"""SELECT priority_label AS baseline_label, {_STRICT} AS variant_label, count(*) AS n_rows,
  count(*) / sum(count(*)) OVER () AS share FROM ranking GROUP BY 1, 2"""
    ),
)
def a21(spark, sf):
    return V.label_transitions(run(spark, sf).ranking, V.LABEL_VARIANTS[2])


@query(
    "a22_variant_by_class",
    twin(
        f"""SELECT *, n_high / n_rows AS share_high, n_medium / n_rows AS share_medium, n_low / n_rows AS share_low FROM (
  SELECT spec_class AS final_coarse_class, count(*) AS n_rows, count(*) FILTER (WHERE v = 'high') AS n_high,
  count(*) FILTER (WHERE v = 'medium') AS n_medium, count(*) FILTER (WHERE v = 'low') AS n_low FROM (SELECT spec_class, {_STRICT} AS v FROM ranking) GROUP BY 1)"""
    ),
)
def a22(spark, sf):
    rows = run(spark, sf).ranking.withColumnRenamed("spec_class", "final_coarse_class")
    return V.label_variant_by_class(rows, V.LABEL_VARIANTS[2])


def _gate_case(v: C.GatePolicy) -> str:
    flame = " WHEN has_missing_flame_features THEN 'review_missing_radius_flame'" if v.require_flame else ""
    return (
        f"CASE WHEN quality_state = 'reject' THEN quality_reason WHEN ruwe > {v.max_ruwe} THEN 'review_high_ruwe' "
        f"WHEN parallax_over_error < {v.min_parallax_snr} THEN 'review_low_parallax_snr'{flame} ELSE 'pass' END"
    )


_GATES = " UNION ALL ".join(
    f"""SELECT '{v.name}' AS policy_name, CAST({v.max_ruwe} AS DOUBLE) AS ruwe_unknown_threshold,
  CAST({v.min_parallax_snr} AS DOUBLE) AS parallax_snr_unknown_threshold, {str(v.require_flame).lower()} AS require_flame_for_pass,
  count(*) AS n_rows, count(*) FILTER (WHERE w = 'pass') AS n_pass_rows, count(*) FILTER (WHERE w LIKE 'review%') AS n_unknown_rows,
  count(*) FILTER (WHERE w LIKE 'reject%') AS n_reject_rows FROM (SELECT {_gate_case(v)} AS w FROM gated)"""
    for v in C.GATE_VARIANTS
)


@query(
    "a23_gate_variants",
    twin(
        f"""SELECT *, n_pass_rows / n_rows AS share_pass, n_unknown_rows / n_rows AS share_unknown, n_reject_rows / n_rows AS share_reject FROM ({_GATES})"""
    ),
)
def a23(spark, sf):
    return V.gate_variant_summary(B.gated(spark, sf))


@query(
    "a24_variant_reasons",
    twin(dist_sql(f"(SELECT {_gate_case(C.GATE_VARIANTS[1])} AS variant_quality_reason FROM gated)", "variant_quality_reason", top=20)),
)
def a24(spark, sf):
    return V.gate_variant_reasons(B.gated(spark, sf), C.GATE_VARIANTS[1])


@query(
    "a24_variant_changes",
    twin(
        f"""SELECT source_id, quality_state, variant_quality_reason FROM (SELECT *, {_gate_case(C.GATE_VARIANTS[1])} AS variant_quality_reason FROM gated)
  WHERE quality_state = 'unknown' AND variant_quality_reason = 'pass' ORDER BY source_id LIMIT 50"""
    ),
)
def a24_changes(spark, sf):
    return V.gate_variant_changes(B.gated(spark, sf), C.GATE_VARIANTS[1]).select(
        "source_id", "quality_state", "variant_quality_reason"
    )


# --- joins and previews of a run ------------------------------------------------------

COHORT_OUT = "source_id, priority_score, final_coarse_class, final_refinement_label, teff_gspphot, ruwe"


@query("j14_high_cohort", twin(f"SELECT {COHORT_OUT} FROM cohort"))
def j14(spark, sf):
    return cohort(spark, sf).select(*COHORT_OUT.split(", "))


STAR_OUT = (
    "source_id, hostname, ra, final_domain_state, final_coarse_class, final_decision_reason, quality_reason, review_bucket, "
    "priority_score, priority_label, teff_gspphot, evolstage_flame"
)
VIEWS["star_level"] = """
SELECT CAST(d.source_id AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS hostname, i.ra, final_domain_state, final_coarse_class, final_coarse_confidence,
  final_refinement_confidence, final_decision_reason, i.quality_reason, i.review_bucket, r.priority_score, r.priority_label, i.teff_gspphot,
  i.evolstage_flame, i.parallax_over_error
FROM dinput i JOIN decisions d USING (source_id) LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id"""


def star_level(spark, sf):
    r = run(spark, sf)
    return V.star_results(r.inputs, r.decisions, r.ranking)


@query("j15_star_results", twin(f"SELECT {STAR_OUT} FROM star_level"))
def j15(spark, sf):
    return star_level(spark, sf).select(*STAR_OUT.split(", "))


VIEWS["browser"] = """
SELECT CAST(d.source_id AS VARCHAR) AS source_id, d.final_domain_state, d.final_coarse_class, r.priority_label, r.priority_score,
  r.host_similarity_score, r.observability_score, i.spec_class, i.spec_subclass, i.quality_reason, i.review_bucket
FROM decisions d JOIN dinput i USING (source_id) LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id"""
BROWSER_OUT = (
    "source_id, final_domain_state, final_coarse_class, priority_label, priority_score, host_similarity_score, observability_score, "
    "spec_class, spec_subclass, quality_reason, review_bucket"
)


def browser(spark, sf):
    r = run(spark, sf)
    return V.run_browser(r.decisions, r.ranking, r.priority_input, r.inputs).select(*BROWSER_OUT.split(", "))


@query("j16_run_browser", twin("SELECT * FROM browser"))
def j16(spark, sf):
    return browser(spark, sf)


LOOKUP_ID = 17


@query(
    "j17_candidate_lookup",
    twin(
        f"SELECT source_id, final_domain_state, quality_reason, priority_label, CAST(observability_score AS DOUBLE) AS observability_score FROM browser WHERE source_id = '{LOOKUP_ID}'"
    ),
)
def j17(spark, sf):
    r = run(spark, sf)
    one = V.lookup(LOOKUP_ID, r.decisions, r.inputs, r.priority_input, r.ranking)
    return V.pad(one, V.SUMMARY_COLUMNS).select(
        "source_id", "final_domain_state", "quality_reason", "priority_label", "observability_score"
    )


@query(
    "j17_candidate_physics",
    twin(f"SELECT {', '.join(c if c != 'source_id' else 'CAST(source_id AS VARCHAR) AS source_id' for c in V.PHYSICS_COLUMNS)} FROM stars WHERE source_id = {LOOKUP_ID}"),
)
def j17_physics(spark, sf):
    r = run(spark, sf)
    return V.pad(V.lookup(LOOKUP_ID, r.decisions, r.inputs), V.PHYSICS_COLUMNS)


@query(
    "j21_top_priority",
    twin(
        """SELECT r.source_id, final_domain_state, final_quality_state, final_coarse_class, final_refinement_label, priority_score, priority_label, priority_reason
  FROM ranking r JOIN decisions d ON CAST(d.source_id AS VARCHAR) = r.source_id
  ORDER BY priority_score DESC, host_similarity_score DESC, observability_score DESC, r.source_id LIMIT 20"""
    ),
)
def j21(spark, sf):
    r = run(spark, sf)
    return V.top_priority(r.ranking, r.decisions)


@query(
    "d23_candidate_route",
    twin(
        """SELECT source_id, unnest(['quality_gate', 'class_refinement', 'final_routing', 'priority_ranking']) AS stage_name,
  unnest([final_quality_state, final_refinement_state, final_domain_state, priority_label]) AS stage_state,
  unnest([quality_reason, final_refinement_label, final_decision_reason, priority_reason]) AS stage_reason FROM (
  SELECT CAST(d.source_id AS VARCHAR) AS source_id, d.*  EXCLUDE (source_id), i.quality_reason, r.priority_label, r.priority_reason FROM decisions d JOIN dinput i USING (source_id)
  LEFT JOIN ranking r ON CAST(d.source_id AS VARCHAR) = r.source_id)"""
    ),
)
def d23(spark, sf):
    r = run(spark, sf)
    summary = V.add_new(V.add_new(r.decisions, r.ranking), r.inputs, ("quality_reason",))
    return V.route_rows(summary)


@query(
    "k03_top_candidates",
    twin(
        "SELECT source_id, spec_class, priority_score, priority_label FROM allranked "
        "ORDER BY priority_score DESC, host_similarity_score DESC, observability_score DESC, source_id LIMIT 20"
    ),
)
def k03(spark, sf):
    from skysieve.operators.ranking import rank_stars

    return rank_stars(st.stars(spark, sf)).select(*V.TOP_SCORING_COLUMNS).limit(20).select(
        "source_id", "spec_class", "priority_score", "priority_label"
    )


@query(
    "k04_cohort_preview",
    twin(
        "SELECT source_id, final_coarse_class, priority_score, teff_gspphot FROM cohort ORDER BY priority_score DESC, host_similarity_score DESC, "
        "observability_score DESC, parallax_over_error DESC NULLS LAST, source_id LIMIT 10"
    ),
)
def k04(spark, sf):
    return V.cohort_preview(cohort(spark, sf)).select(
        "source_id", "final_coarse_class", "priority_score", "teff_gspphot"
    )


@query(
    "k05_star_preview",
    twin(
        "SELECT source_id, priority_score, final_decision_reason FROM star_level WHERE final_domain_state = 'id' ORDER BY priority_score DESC NULLS LAST, "
        "final_refinement_confidence DESC NULLS LAST, final_coarse_confidence DESC NULLS LAST, parallax_over_error DESC NULLS LAST, source_id LIMIT 20"
    ),
)
def k05(spark, sf):
    return V.star_preview(star_level(spark, sf), "id").select(
        "source_id", "priority_score", "final_decision_reason"
    )


@query(
    "k05_other_preview",
    twin(
        "SELECT source_id, final_decision_reason, review_bucket FROM star_level WHERE final_domain_state = 'unknown' ORDER BY final_decision_reason, "
        "review_bucket NULLS LAST, quality_reason NULLS LAST, parallax_over_error DESC NULLS LAST, source_id LIMIT 20"
    ),
)
def k05_other(spark, sf):
    return V.star_preview(star_level(spark, sf), "unknown").select(
        "source_id", "final_decision_reason", "review_bucket"
    )


@query(
    "k08_browser_filter",
    twin(
        "SELECT * FROM browser WHERE final_domain_state IN ('id', 'unknown') AND priority_label IN ('high', 'medium') "
        "AND spec_class IN ('G', 'K') AND contains(source_id, '1') ORDER BY priority_score DESC, host_similarity_score DESC, observability_score DESC, source_id LIMIT 25"
    ),
)
def k08(spark, sf):
    wanted = V.BrowserFilter(("id", "unknown"), ("high", "medium"), ("G", "K"), " 1 ")
    return V.filter_browser(browser(spark, sf), wanted).orderBy(*V.browser_order()).limit(25)


@query(
    "k09_filter_options",
    twin(
        """SELECT column_name, label, CAST(CASE WHEN label = 'high' OR label = 'id' THEN 0 WHEN label IN ('medium', 'unknown') THEN 1 WHEN label IN ('low', 'ood') THEN 2 END AS INT)
  AS preferred_position FROM (SELECT DISTINCT 'final_domain_state' AS column_name, final_domain_state AS label FROM browser
  UNION SELECT DISTINCT 'priority_label', priority_label FROM browser WHERE priority_label IS NOT NULL UNION SELECT DISTINCT 'spec_class', spec_class FROM browser)"""
    ),
)
def k09(spark, sf):
    return V.filter_options(browser(spark, sf))


# --- hosts and scoring runs -----------------------------------------------------------

_READY = " AND ".join(f"{c} IS NOT NULL" for c in C.HOST_CORE_FEATURES)
VIEWS["host_frame"] = """
SELECT source_id, teff_gspphot, logg_gspphot, mh_gspphot, bp_rp, parallax, parallax_over_error, ruwe, radius_flame, phot_g_mean_mag, lum_flame, evolstage_flame,
  radius_flame AS radius_gspphot, spec_class, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS evolution_stage,
  CASE WHEN spec_subclass <> 'x?' THEN spec_subclass END AS spec_subclass
FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND radius_flame IS NOT NULL"""


@query(
    "a36_host_contract",
    twin(
        f"""SELECT *, n_rows_with_canonical_radius / n_rows AS share_rows_with_canonical_radius, n_rows_clean_core_ready / n_rows AS share_rows_clean_core_ready FROM (
  SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_unique_source_id, count(DISTINCT spec_class) AS n_supported_classes,
  count(DISTINCT evolution_stage) AS n_supported_stages, CAST(8 AS INT) AS n_core_features, CAST(8 AS INT) AS n_core_features_present, true AS has_canonical_radius_column,
  count(radius_flame) AS n_rows_with_canonical_radius, count(*) FILTER (WHERE {_READY}) AS n_rows_clean_core_ready FROM host_frame)"""
    ),
)
def a36(spark, sf):
    return V.host_contract_summary(host_contract_side(spark, sf))


_COVER = " UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, count({c if c not in ('ra', 'dec') else 'NULL'}) AS n_non_missing, "
    f"count({c if c not in ('ra', 'dec') else 'NULL'}) / count(*) AS share_non_missing, "
    f"'{'core' if c in C.HOST_CORE_FEATURES else 'observability' if c in C.HOST_OBSERVABILITY_FEATURES else 'context' if c in C.HOST_CONTEXT_FEATURES else 'optional_physical'}' AS feature_group, "
    f"{str(c in C.HOST_CORE_FEATURES).lower()} AS is_required, {str(c not in ('ra', 'dec')).lower()} AS column_present FROM host_frame"
    for c in C.HOST_ALL_FEATURES
)


@query("a36_feature_coverage", twin(_COVER))
def a36_coverage(spark, sf):
    return V.feature_coverage(host_contract_side(spark, sf))


_MISS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, count(*) - count({c}) AS n_missing_rows, 1E0 - count({c}) / count(*) AS share_missing_rows, true AS column_present FROM host_frame"
    for c in C.HOST_CORE_FEATURES
)


@query("a36_missing_core", twin(_MISS))
def a36_missing(spark, sf):
    return V.missing_core(host_contract_side(spark, sf))


@query(
    "a37_host_training_summary",
    twin(
        """SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_unique_source_id, CAST(0 AS BIGINT) AS n_unique_hostname, count(spec_subclass) AS n_spec_subclass_rows,
  count(DISTINCT spec_class) AS n_supported_classes, count(DISTINCT evolution_stage) AS n_supported_stages FROM host_frame"""
    ),
)
def a37(spark, sf):
    return V.host_training_summary(host_contract_side(spark, sf))


@query("a37_host_classes", twin(dist_sql("host_frame", "spec_class")))
def a37_classes(spark, sf):
    return distribution(host_contract_side(spark, sf), "spec_class")


@query("a37_host_stages", twin(dist_sql("host_frame", "evolution_stage")))
def a37_stages(spark, sf):
    return distribution(host_contract_side(spark, sf), "evolution_stage")


@query(
    "a38_observability_coverage",
    twin(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric_name, round(avg(CAST({c} AS INT)), 6) AS metric_value FROM allranked"
            for c in ("brightness_available", "distance_available", "astrometry_available")
        )
        + " UNION ALL SELECT 'mean_observability_evidence_count', round(avg(observability_evidence_count), 6) FROM allranked"
    ),
)
def a38(spark, sf):
    return rounded(V.observability_coverage(score_priority(st.stars(spark, sf))), "metric_value")


_TOP = "(SELECT * FROM allranked ORDER BY priority_score DESC, host_similarity_score DESC, observability_score DESC, source_id LIMIT 500)"
_ALIGN = {
    "top_n": "count(*)",
    "target_class_share": "avg(CAST(spec_class IN ('F', 'G', 'K', 'M') AS INT))",
    "low_priority_class_share": "avg(CAST(spec_class IN ('O', 'B', 'A') AS INT))",
    "dwarf_share": "avg(CAST(evolution_stage = 'dwarf' AS INT))",
    "evolved_share": "avg(CAST(evolution_stage <> 'dwarf' AS INT))",
    "high_priority_share": "avg(CAST(priority_label = 'high' AS INT))",
    "medium_priority_share": "avg(CAST(priority_label = 'medium' AS INT))",
    "low_priority_share": "avg(CAST(priority_label = 'low' AS INT))",
    "mean_host_similarity_score": "avg(host_similarity_score)",
    "mean_observability_score": "avg(observability_score)",
    "mean_observability_evidence_count": "avg(observability_evidence_count)",
    "mean_priority_score": "avg(priority_score)",
}


@query(
    "a39_goal_alignment",
    twin(" UNION ALL ".join(f"SELECT '{n}' AS metric_name, round(CAST({e} AS DOUBLE), 6) AS metric_value FROM {_TOP}" for n, e in _ALIGN.items())),
)
def a39(spark, sf):
    return rounded(V.goal_alignment(score_priority(st.stars(spark, sf)), 500), "metric_value")


@query(
    "a50_target_distribution",
    twin(
        """SELECT split_name, target_label, n_rows, n_rows / sum(n_rows) OVER (PARTITION BY split_name) AS share FROM (
  SELECT split_name, spec_class AS target_label, count(*) AS n_rows FROM split_rows GROUP BY 1, 2
  UNION ALL SELECT 'full', spec_class, count(*) FROM split_rows GROUP BY 2)"""
    ),
)
def a50(spark, sf):
    return label_shares(coarse_split(spark, sf), "spec_class")


@query(
    "a51_subclass_coverage",
    twin(
        """SELECT spec_class, count(*) AS n_rows, count(spec_subclass) AS n_with_subclass, count(spec_subclass) / count(*) AS share_with_subclass,
  count(DISTINCT spec_subclass) AS n_subclasses FROM stars GROUP BY 1"""
    ),
)
def a51(spark, sf):
    return V.subclass_coverage(st.stars(spark, sf, "spec_class", "spec_subclass"))


@query(
    "a51_missing_report",
    twin(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature_name, count({c}) AS n_non_missing, count({c}) / count(*) AS share_non_missing FROM stars"
            for c in C.CORE_FEATURES
        )
    ),
)
def a51_missing(spark, sf):
    return V.column_coverage(st.stars(spark, sf), C.CORE_FEATURES).drop("_n")


# benchmark tables: one run per market segment, models and scores from customers
VIEWS["bench_metrics"] = """
SELECT c_mktsegment AS run_id, 'm' || c_nationkey AS model_name, CASE WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'train' END AS split_name,
  (c_custkey * 7 % 1000) / 1E3 AS accuracy, (c_custkey * 3 % 900) / 1E3 AS balanced_accuracy, (c_custkey * 11 % 800) / 1E3 AS macro_f1 FROM customer"""
VIEWS["bench_cv"] = """
SELECT c_mktsegment AS run_id, 'm' || c_nationkey AS model_name, (c_custkey * 5 % 1000) / 1E3 AS mean_accuracy, (c_custkey * 13 % 900) / 1E3
  AS mean_balanced_accuracy, (c_custkey * 17 % 800) / 1E3 AS mean_macro_f1 FROM customer"""
VIEWS["bench_best"] = """
SELECT run_id, t.best_test_model, test_accuracy, test_balanced_accuracy, test_macro_f1, best_cv_model, cv_mean_accuracy, cv_mean_balanced_accuracy, cv_mean_macro_f1 FROM
 (SELECT run_id, model_name AS best_test_model, accuracy AS test_accuracy, balanced_accuracy AS test_balanced_accuracy, macro_f1 AS test_macro_f1,
   row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, macro_f1 DESC, balanced_accuracy DESC) AS rn FROM bench_metrics WHERE split_name = 'test') t
 JOIN (SELECT run_id, model_name AS best_cv_model, mean_accuracy AS cv_mean_accuracy, mean_balanced_accuracy AS cv_mean_balanced_accuracy,
   mean_macro_f1 AS cv_mean_macro_f1, row_number() OVER (PARTITION BY run_id ORDER BY mean_macro_f1 DESC, mean_accuracy DESC, mean_balanced_accuracy DESC) AS rn
   FROM bench_cv) c USING (run_id) WHERE t.rn = 1 AND c.rn = 1"""


def bench_tables(spark, sf):
    base = st.table(spark, sf, "customer")
    key = [F.col("c_mktsegment").alias("run_id"), F.expr("'m' || c_nationkey").alias("model_name")]
    metrics = base.select(
        *key,
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'train' END").alias("split_name"),
        F.expr("(c_custkey * 7 % 1000) / 1E3").alias("accuracy"),
        F.expr("(c_custkey * 3 % 900) / 1E3").alias("balanced_accuracy"),
        F.expr("(c_custkey * 11 % 800) / 1E3").alias("macro_f1"),
    )
    cv = base.select(
        *key,
        F.expr("(c_custkey * 5 % 1000) / 1E3").alias("mean_accuracy"),
        F.expr("(c_custkey * 13 % 900) / 1E3").alias("mean_balanced_accuracy"),
        F.expr("(c_custkey * 17 % 800) / 1E3").alias("mean_macro_f1"),
    )
    return metrics, cv


@query("k10_best_models", twin("SELECT * FROM bench_best"))
def k10(spark, sf):
    return V.best_rows(*bench_tables(spark, sf))


_BEST = ("test_accuracy", "test_balanced_accuracy", "test_macro_f1", "cv_mean_accuracy", "cv_mean_balanced_accuracy", "cv_mean_macro_f1")


@query(
    "e12_stage_metrics",
    twin(" UNION ALL ".join(f"SELECT run_id, '{c}' AS metric_name, {c} AS metric_value FROM bench_best" for c in _BEST)),
)
def e12(spark, sf):
    return V.metrics_long(V.best_rows(*bench_tables(spark, sf)))
