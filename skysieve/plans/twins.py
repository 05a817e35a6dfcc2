"""SQL views that the DuckDB twins of the registered queries build on.

Written from the rules, not from the Spark code: a twin is a second opinion.
"""

from __future__ import annotations

from skysieve import contracts as C
from skysieve.plans import stars as st
from skysieve.plans.registry import with_views

CORE = ("teff_gspphot", "logg_gspphot", "mh_gspphot", "bp_rp", "parallax", "parallax_over_error", "ruwe")
CORE_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in CORE)


def linear(x: str, low: str, high: str, rising: bool = True) -> str:
    share = f"({x} - {low}) / ({high} - {low})"
    score = share if rising else f"1E0 - {share}"
    return f"CASE WHEN {x} IS NULL THEN 5E-1 ELSE greatest(0E0, least(1E0, {score})) END"


def unit(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0E0, least(1E0, {x})) END"


VIEWS: dict[str, str] = {
    "stars": st.star_sql(),
    "cand": st.candidate_sql(),
    "members": st.membership_sql(),
    "gated": f"""
SELECT s.*, ({CORE_PRESENT}) AS has_core_features, radius_flame IS NOT NULL AS has_flame_features,
  non_single_star > 0 AS has_non_single_star_flag,
  coalesce(classprob_dsc_combmod_star < 5E-1, false) AS has_low_single_star_probability,
  NOT ({CORE_PRESENT}) AS has_missing_core_features, radius_flame IS NULL AS has_missing_flame_features,
  coalesce(ruwe > 1.4E0, false) AS has_high_ruwe,
  coalesce(parallax_over_error < 5E0, false) AS has_low_parallax_snr,
  s.source_id IN (SELECT source_id FROM members) AS in_ood_reference,
  CASE WHEN NOT ({CORE_PRESENT}) THEN 'reject' WHEN ruwe > 1.4E0 OR parallax_over_error < 5E0 OR radius_flame IS NULL
    THEN 'unknown' ELSE 'pass' END AS quality_state,
  CASE WHEN NOT ({CORE_PRESENT}) THEN 'reject_missing_core_features' WHEN ruwe > 1.4E0 THEN 'review_high_ruwe'
    WHEN parallax_over_error < 5E0 THEN 'review_low_parallax_snr'
    WHEN radius_flame IS NULL THEN 'review_missing_radius_flame' ELSE 'pass' END AS quality_reason,
  CASE WHEN s.source_id IN (SELECT source_id FROM members) THEN 'ood'
    WHEN non_single_star > 0 OR classprob_dsc_combmod_star < 5E-1 THEN 'candidate_ood' ELSE 'in_domain' END AS ood_state,
  CASE WHEN s.source_id IN (SELECT source_id FROM members) THEN 'ood_reference_member'
    WHEN non_single_star > 0 THEN 'non_single_star'
    WHEN classprob_dsc_combmod_star < 5E-1 THEN 'low_single_star_probability' END AS ood_reason,
  CASE WHEN NOT ({CORE_PRESENT}) THEN 'reject_missing_core_features' WHEN non_single_star > 0 THEN 'review_non_single_star'
    WHEN classprob_dsc_combmod_star < 5E-1 THEN 'review_low_single_star_probability'
    WHEN ruwe > 1.4E0 THEN 'review_high_ruwe' WHEN parallax_over_error < 5E0 THEN 'review_low_parallax_snr'
    WHEN radius_flame IS NULL THEN 'review_missing_radius_flame' ELSE 'pass' END AS review_bucket
FROM stars s""",
    "tuned": """
SELECT g.* EXCLUDE (quality_state, quality_reason, review_bucket),
  CASE WHEN quality_state = 'reject' THEN 'reject' WHEN ruwe > 1.4E0 OR parallax_over_error < 5E0 OR has_missing_flame_features
    THEN 'unknown' ELSE 'pass' END AS quality_state,
  CASE WHEN quality_state = 'reject' THEN quality_reason WHEN ruwe > 1.4E0 THEN 'review_high_ruwe'
    WHEN parallax_over_error < 5E0 THEN 'review_low_parallax_snr'
    WHEN has_missing_flame_features THEN 'review_missing_radius_flame' ELSE 'pass' END AS quality_reason,
  CASE WHEN quality_state = 'reject' THEN review_bucket WHEN ruwe > 1.4E0 THEN 'review_high_ruwe'
    WHEN parallax_over_error < 5E0 THEN 'review_low_parallax_snr'
    WHEN has_missing_flame_features THEN 'review_missing_radius_flame' ELSE 'pass' END AS review_bucket
FROM gated g""",
    "coarse": """
SELECT source_id, arg_max(label, (p, -ord)) AS label, max(p) AS pmax,
  max(p) - max(p) FILTER (WHERE rn = 2) AS margin
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY p DESC, ord) AS rn FROM (
  SELECT source_id, unnest(['A','B','F','G','K','M','O']) AS label, unnest([1,2,3,4,5,6,7]) AS ord,
    unnest([p_A, p_B, p_F, p_G, p_K, p_M, p_O]) AS p FROM stars)) GROUP BY source_id""",
    "dinput": """
SELECT t.*, d AS ood_decision, 1E0 - ood_probability AS id_probability,
  CASE WHEN d = 'in_domain' THEN c.label END AS coarse_predicted_label,
  CASE WHEN d = 'in_domain' THEN c.pmax END AS coarse_probability_max,
  CASE WHEN d = 'in_domain' THEN c.margin END AS coarse_probability_margin,
  CASE WHEN d = 'in_domain' AND c.label <> 'O' AND c.pmax >= 6E-1 THEN refinement_label END AS refinement_predicted_label,
  CASE WHEN d = 'in_domain' AND c.label <> 'O' AND c.pmax >= 6E-1 THEN refinement_probability END AS refinement_probability_max
FROM (SELECT *, CASE WHEN ood_probability >= 9E-1 THEN 'ood' WHEN ood_probability >= 8E-1 THEN 'candidate_ood'
  ELSE 'in_domain' END AS d FROM tuned) t JOIN coarse c USING (source_id)""",
    "decisions": """
SELECT source_id,
  CASE WHEN why = 'hard_ood' THEN 'ood' WHEN why = 'candidate_ood' THEN 'candidate_ood'
    WHEN why IN ('coarse_class_not_enabled', 'coarse_probability_below_threshold', 'refinement_accepted') THEN 'id'
    ELSE 'unknown' END AS final_domain_state,
  quality_state AS final_quality_state,
  CASE WHEN reached THEN coarse_predicted_label END AS final_coarse_class,
  CASE WHEN reached THEN coarse_probability_max END AS final_coarse_confidence,
  CASE WHEN why = 'refinement_accepted' THEN refinement_predicted_label END AS final_refinement_label,
  CASE WHEN why = 'refinement_accepted' THEN 'accepted'
    WHEN why IN ('refinement_label_missing', 'refinement_confidence_below_threshold') THEN 'rejected_to_unknown'
    ELSE 'not_attempted' END AS final_refinement_state,
  CASE WHEN why = 'refinement_accepted' THEN refinement_probability_max END AS final_refinement_confidence,
  why AS final_decision_reason, 'final_decision_v1' AS final_decision_policy_version,
  CAST(NULL AS VARCHAR) AS priority_state
FROM (SELECT *, why NOT IN ('quality_reject', 'quality_unknown', 'hard_ood', 'candidate_ood') AS reached FROM (
  SELECT *, CASE WHEN quality_state = 'reject' THEN 'quality_reject' WHEN quality_state = 'unknown' THEN 'quality_unknown'
    WHEN ood_decision = 'ood' THEN 'hard_ood' WHEN ood_decision = 'candidate_ood' THEN 'candidate_ood'
    WHEN coarse_predicted_label = 'O' THEN 'coarse_class_not_enabled'
    WHEN coarse_probability_max < 6E-1 THEN 'coarse_probability_below_threshold'
    WHEN refinement_predicted_label IS NULL THEN 'refinement_label_missing'
    WHEN refinement_probability_max < 1E-1 THEN 'refinement_confidence_below_threshold'
    ELSE 'refinement_accepted' END AS why FROM dinput))""",
    "pinput": """
SELECT source_id, final_coarse_class AS spec_class, host_similarity_score, evolution_stage, parallax, phot_g_mean_mag,
  parallax_over_error, ruwe, validation_factor
FROM decisions JOIN stars USING (source_id)
WHERE final_domain_state = 'id' AND final_quality_state = 'pass' AND final_coarse_class IS NOT NULL""",
    "ranking": "",
    "allranked": "",
}


def ranking_sql(source: str) -> str:
    stage = "CASE WHEN lower(trim(evolution_stage)) IN ('subgiant', 'giant', 'evolved') THEN 'evolved' ELSE lower(trim(evolution_stage)) END"
    return f"""
SELECT source_id, spec_class, evolution_stage, class_priority_score, host_similarity_score, brightness_score, distance_score,
  astrometry_score, observability_score, brightness_available, distance_available, astrometry_available,
  observability_evidence_count, priority_score,
  CASE WHEN priority_score >= 75E-2 THEN 'high' WHEN priority_score >= 45E-2 THEN 'medium' ELSE 'low' END AS priority_label,
  coalesce(nullif(concat_ws('; ',
    CASE WHEN spec_class IN ('O', 'B', 'A') THEN '@low_priority_class@' WHEN st = 'evolved' THEN '@evolved_stage_penalty@' END,
    CASE WHEN host_similarity_score >= 75E-2 THEN '@strong_host_signal@' WHEN host_similarity_score <= 35E-2 THEN '@weak_host_signal@' END,
    CASE WHEN observability_score >= 7E-1 THEN '@good_observability@' WHEN observability_score <= 35E-2 THEN '@limited_observability@' END,
    CASE WHEN observability_evidence_count = 0 THEN '@observability_without_inputs@'
      WHEN observability_evidence_count < 3 THEN '@observability_with_partial_inputs@' END), ''), '@balanced_profile@') AS priority_reason
FROM (SELECT *, CASE WHEN spec_class IN ('O', 'B', 'A') THEN least(raw_score, 34E-2) ELSE raw_score END AS priority_score FROM (
 SELECT *, greatest(0E0, least(1E0, 2E-1 * class_priority_score + 45E-2 * host_similarity_score + 35E-2 * observability_score)) AS raw_score
 FROM (SELECT *, greatest(0E0, least(1E0, 4E-1 * brightness_score + 35E-2 * distance_score + 25E-2 * astrometry_score)) AS observability_score
 FROM (SELECT CAST(source_id AS VARCHAR) AS source_id, spec_class, evolution_stage, {stage} AS st,
   CASE WHEN spec_class IN ('F', 'G', 'K', 'M') AND {stage} = 'evolved' THEN 85E-2 WHEN spec_class IN ('F', 'G', 'K', 'M') THEN 1E0
     WHEN spec_class IN ('O', 'B', 'A') THEN 2E-1 ELSE 5E-1 END AS class_priority_score,
   coalesce({unit('host_similarity_score')}, 5E-1) AS host_similarity_score,
   {linear('phot_g_mean_mag', '10E0', '16E0', False)} AS brightness_score,
   {linear('parallax', '2E0', '20E0')} AS distance_score,
   CASE WHEN parallax_over_error IS NULL AND ruwe IS NULL AND validation_factor IS NULL THEN 5E-1 ELSE
     greatest(0E0, least(1E0, (0E0 + CASE WHEN parallax_over_error IS NULL THEN 0E0 ELSE {linear('parallax_over_error', '5E0', '20E0')} END
       + CASE WHEN ruwe IS NULL THEN 0E0 ELSE {linear('ruwe', '1E0', '1.4E0', False)} END
       + CASE WHEN validation_factor IS NULL THEN 0E0 ELSE {unit('validation_factor')} END)
      / (CAST(parallax_over_error IS NOT NULL AS INT) + CAST(ruwe IS NOT NULL AS INT) + CAST(validation_factor IS NOT NULL AS INT)))) END
     AS astrometry_score,
   phot_g_mean_mag IS NOT NULL AS brightness_available, parallax IS NOT NULL AS distance_available,
   (parallax_over_error IS NOT NULL OR ruwe IS NOT NULL OR validation_factor IS NOT NULL) AS astrometry_available,
   CAST(phot_g_mean_mag IS NOT NULL AS INT) + CAST(parallax IS NOT NULL AS INT)
     + CAST(parallax_over_error IS NOT NULL OR ruwe IS NOT NULL OR validation_factor IS NOT NULL AS INT) AS observability_evidence_count
 FROM {source}))))"""


def with_reason_texts(sql: str) -> str:
    for code, text in C.PRIORITY_REASONS.items():
        sql = sql.replace(f"@{code}@", text)
    return sql


VIEWS["ranking"] = with_reason_texts(ranking_sql("pinput"))
VIEWS["allranked"] = with_reason_texts(ranking_sql("stars"))


def twin(body: str) -> str:
    return with_views(VIEWS, body)


def dist_sql(view: str, column: str, label: str | None = None, top: int | None = None, where: str = "true") -> str:
    label = label or column
    tail = f" ORDER BY n_rows DESC, {label} LIMIT {top}" if top else ""
    return (
        f"SELECT coalesce(CAST({column} AS VARCHAR), '<NA>') AS {label}, count(*) AS n_rows, "
        f"count(*) / sum(count(*)) OVER () AS share FROM {view} WHERE {where} GROUP BY 1{tail}"
    )
