"""Registered queries: scans, validation, training frames, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import labels as LB
from skysieve.functions.numeric import to_number
from skysieve.operators import frames as FR
from skysieve.operators import guards as G
from skysieve.operators import layers as L
from skysieve.operators import sampling as SM
from skysieve.plans import bundles as B
from skysieve.plans import stars as st
from skysieve.plans.registry import query
from skysieve.plans.twins import CORE_PRESENT, VIEWS, twin
from skysieve.session import scratch_path
from skysieve.sources import relations as R

FAMILY_COLS = C.FAMILY_TRAINING.required


def stars(spark, sf):
    return st.stars(spark, sf)


def roundtrip_csv(df, spark, name):
    path = scratch_path(spark, name)
    df.write.csv(path, header=True, quote='"', escape='"')
    return R.read_star_csv(spark, path)


def text_id():
    return F.concat(F.lit("Gaia, "), F.col("source_id").cast("string"))


@query(
    "s02_decision_csv",
    twin(
        "SELECT 'Gaia, ' || source_id AS source_id, quality_state, 'var' || source_id % 3 AS peculiarity_suffix, "
        "source_id % 2 = 0 AS is_evolved, teff_gspphot, radius_flame, radius_flame AS radius_feature, "
        "radius_flame AS radius_gspphot FROM gated"
    ),
)
def s02(spark, sf):
    flag, suffix = (F.col("source_id") % 2 == 0).cast("int"), F.concat(F.lit("var"), (F.col("source_id") % 3).cast("string"))
    sent = B.gated(spark, sf).select(
        text_id().alias("source_id"), "quality_state", suffix.alias("peculiarity_suffix"), flag.alias("is_evolved"),
        "teff_gspphot", "radius_flame",
    )
    return R.alias_features(roundtrip_csv(sent, spark, "decision-csv"), ("radius_feature", "radius_gspphot"))


@query(
    "s03_score_csv",
    twin(
        "SELECT 'Gaia, ' || source_id AS source_id, ruwe, teff_gspphot FROM stars "
        "WHERE ruwe IS NOT NULL AND teff_gspphot IS NOT NULL"
    ),
)
def s03(spark, sf):
    sent = st.stars(spark, sf, "source_id", "ruwe", "teff_gspphot").withColumn("source_id", text_id())
    return R.scoring_rows(roundtrip_csv(sent, spark, "score-csv"), ("ruwe", "teff_gspphot"))


@query(
    "s04_candidate_csv",
    twin(
        "SELECT 'Gaia, ' || source_id AS source_id, 'HOST, \"' || source_id AS hostname, spec_class, "
        "'note ' || source_id % 5 AS external_object_id, bp_rp, parallax FROM stars"
    ),
)
def s04(spark, sf):
    host = F.concat(F.lit('HOST, "'), F.col("source_id").cast("string"))
    note = F.concat(F.lit("note "), (F.col("source_id") % 5).cast("string"))
    sent = st.stars(spark, sf, "source_id", "spec_class", "bp_rp", "parallax").select(
        text_id().alias("source_id"), host.alias("hostname"), "spec_class", note.alias("external_object_id"), "bp_rp", "parallax"
    )
    return R.open_relation(spark, roundtrip_csv(sent, spark, "candidate-csv"))


@query(
    "s05_router_scan",
    twin(
        """SELECT source_id, spec_class, evolution_stage, radius_gspphot FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL
  AND radius_gspphot IS NOT NULL AND evolution_stage = 'dwarf'"""
    ),
)
def s05(spark, sf):
    return R.router_rows(stars(spark, sf)).select("source_id", "spec_class", "evolution_stage", "radius_gspphot")


@query(
    "s05_router_scan_limited",
    twin(
        """SELECT source_id, random_index FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL
  AND radius_gspphot IS NOT NULL AND evolution_stage = 'dwarf' ORDER BY random_index, source_id LIMIT 50"""
    ),
)
def s05_limited(spark, sf):
    return R.router_rows(stars(spark, sf), limit=50).select("source_id", "random_index")


@query(
    "s06_host_scan",
    twin(
        """SELECT source_id, evolution_stage, radius_flame FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL
  AND radius_flame IS NOT NULL"""
    ),
)
def s06(spark, sf):
    return R.host_rows(stars(spark, sf)).select("source_id", "evolution_stage", "radius_flame")


@query("s07_coarse_scan", twin(f"SELECT source_id, spec_class, is_evolved FROM stars WHERE {CORE_PRESENT}"))
def s07(spark, sf):
    return R.coarse_rows(stars(spark, sf)).select("source_id", "spec_class", "is_evolved")


@query(
    "s08_ood_scan",
    twin(
        f"""SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'id' ELSE 'ood' END AS domain_target FROM stars
  WHERE source_id % 3 <> 0 AND {CORE_PRESENT}"""
    ),
)
def s08(spark, sf):
    df = stars(spark, sf).withColumn(
        "domain_target",
        F.expr("CASE WHEN source_id % 3 = 0 THEN 'other' WHEN source_id % 2 = 0 THEN 'id' ELSE 'ood' END"),
    )
    return R.ood_rows(df).select("source_id", "domain_target")


@query(
    "s09_refinement_scan",
    twin(
        f"""SELECT source_id, spectral_class, spectral_subclass FROM stars WHERE {CORE_PRESENT} AND radius_flame IS NOT NULL
  AND spectral_subclass IS NOT NULL"""
    ),
)
def s09(spark, sf):
    return R.refinement_rows(stars(spark, sf)).select("source_id", "spectral_class", "spectral_subclass")


def with_full_label(df):
    return df.withColumn(
        "full_subclass_label", F.concat("spectral_class", F.col("spectral_subclass").cast("string"))
    )


@query(
    "s10_family_scan",
    twin("SELECT source_id, spectral_subclass FROM stars WHERE spectral_class = 'K' AND spectral_subclass IS NOT NULL"),
)
def s10(spark, sf):
    path = scratch_path(spark, "families")
    with_full_label(stars(spark, sf)).select(*C.FAMILY_TRAINING.columns([*FAMILY_COLS])).write.partitionBy(
        "spectral_class"
    ).parquet(path)
    return R.family_rows(R.open_relation(spark, path), "K").select("source_id", "spectral_subclass")


ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in C.ROUTER_FEATURES)


@query("s11_scoring_scan", twin(f"SELECT source_id, teff_gspphot, spec_class FROM stars WHERE {ALL_PRESENT}"))
def s11(spark, sf):
    return R.scoring_rows(stars(spark, sf), C.ROUTER_FEATURES).select("source_id", "teff_gspphot", "spec_class")


@query(
    "s12_decision_scan",
    twin("SELECT source_id, quality_state, radius_flame AS radius_feature FROM gated WHERE quality_state IS NOT NULL"),
)
def s12(spark, sf):
    return R.decision_rows(B.gated(spark, sf), C.COARSE_FEATURES).select(
        "source_id", "quality_state", "radius_feature"
    )


@query(
    "s13_gate_audit_scan",
    twin(
        "SELECT source_id, quality_state, ood_state, has_core_features, review_bucket, random_index FROM gated "
        "ORDER BY random_index, quality_state, source_id LIMIT 200"
    ),
)
def s13(spark, sf):
    return R.gate_audit_rows(B.gated(spark, sf), limit=200).select(
        "source_id", "quality_state", "ood_state", "has_core_features", "review_bucket", "random_index"
    )


@query(
    "s14_hot_boundary_scan",
    twin(
        "SELECT source_id, spectral_class, teff_gspphot FROM gated WHERE spectral_class IN ('O', 'B') "
        "AND quality_state = 'pass' AND teff_gspphot >= 1E4"
    ),
)
def s14(spark, sf):
    return R.hot_boundary_rows(B.gated(spark, sf)).select("source_id", "spectral_class", "teff_gspphot")


@query(
    "s15_o_review_scan",
    twin("SELECT source_id, quality_reason FROM gated WHERE spectral_class = 'O' AND quality_state = 'unknown'"),
)
def s15(spark, sf):
    return R.o_review_rows(B.gated(spark, sf), "unknown").select("source_id", "quality_reason")


@query(
    "p01_contract_projection",
    twin(
        "SELECT source_id, ra, dec, teff_gspphot, logg_gspphot, radius_gspphot, spec_class, evolution_stage, spec_subclass, parallax, "
        "parallax_over_error, ruwe, mh_gspphot, bp_rp, random_index FROM stars"
    ),
)
def p01(spark, sf):
    return R.project(stars(spark, sf), C.ROUTER_TRAINING)


def _missing_rows(spark, sf, contracts):
    """Missing required columns per contract, beside the row count of the checked table."""
    df = stars(spark, sf).drop("ruwe", "radius_flame")
    gaps = [(c.name, name) for c in contracts for name in c.missing(df.columns)]
    n = df.agg(F.count("*").alias("n_rows"))
    rows = F.explode(
        F.array(*[F.struct(F.lit(a).alias("contract"), F.lit(b).alias("missing")) for a, b in gaps])
    )
    return n.select("n_rows", rows.alias("g")).select("g.contract", "g.missing", "n_rows")


@query(
    "p02_missing_columns",
    twin(
        "SELECT 'host training frame' AS contract, 'radius_flame' AS missing, count(*) AS n_rows FROM stars "
        "UNION ALL SELECT 'coarse training frame', 'ruwe', count(*) FROM stars"
    ),
)
def p02(spark, sf):
    return _missing_rows(spark, sf, (C.ROUTER_TRAINING, C.HOST_TRAINING, C.COARSE_TRAINING))


@query(
    "p03_relation_checks",
    twin(
        "SELECT 'id/ood training frame' AS contract, unnest(['domain_target', 'ruwe']) AS missing, n_rows FROM (SELECT count(*) AS n_rows FROM stars)"
    ),
)
def p03(spark, sf):
    return _missing_rows(spark, sf, (C.OOD_TRAINING,))


@query(
    "p04_lenient_numbers",
    twin("SELECT source_id, CASE WHEN source_id % 6 < 2 THEN NULL ELSE source_id / 4E0 END AS value FROM stars"),
)
def p04(spark, sf):
    text = F.expr(
        "CASE source_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' ELSE CAST(source_id / 4E0 AS STRING) END"
    )
    return st.stars(spark, sf, "source_id").select("source_id", to_number(text).alias("value"))


@query(
    "p05_coarse_frame",
    twin(
        f"SELECT source_id, spec_class, CASE WHEN is_evolved THEN 'evolved' ELSE 'dwarf' END AS evolution_stage FROM stars WHERE {CORE_PRESENT}"
    ),
)
def p05(spark, sf):
    return FR.coarse_frame(stars(spark, sf)).select("source_id", "spec_class", "evolution_stage")


@query(
    "p06_router_frame",
    twin(
        """SELECT source_id, spec_class, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS evolution_stage, radius_gspphot
  FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND radius_gspphot IS NOT NULL"""
    ),
)
def p06(spark, sf):
    return FR.router_frame(stars(spark, sf).drop("spec_subclass")).select(
        "source_id", "spec_class", "evolution_stage", "radius_gspphot"
    )


@query(
    "p07_label_normalisation",
    twin(
        """SELECT source_id, spec_class, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS evolution_stage,
  upper(spec_subclass) AS spec_subclass FROM stars"""
    ),
)
def p07(spark, sf):
    messy = st.stars(spark, sf, "source_id", "spec_class", "evolution_stage", "spec_subclass").withColumns(
        {
            "spec_class": F.concat(F.lit(" "), F.lower("spec_class")),
            "evolution_stage": F.concat(F.upper("evolution_stage"), F.lit(" ")),
        }
    )
    return FR.normalize_labels(messy)


@query(
    "p08_host_frame",
    twin(
        """SELECT source_id, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS evolution_stage,
  CASE WHEN spec_subclass <> 'x?' THEN spec_subclass END AS spec_subclass, radius_flame AS radius_gspphot, radius_gspphot AS radius_gspphot_legacy
  FROM stars WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND radius_flame IS NOT NULL"""
    ),
)
def p08(spark, sf):
    return FR.host_frame(stars(spark, sf)).select(
        "source_id", "evolution_stage", "spec_subclass", "radius_gspphot", "radius_gspphot_legacy"
    )


@query(
    "p09_label_violations",
    twin(
        "SELECT 'spec_subclass' AS column_name, 'x?' AS bad_value UNION ALL "
        "SELECT DISTINCT 'evolution_stage', 'stage' || (source_id % 3) FROM stars WHERE source_id % 500 < 3"
    ),
)
def p09(spark, sf):
    odd = stars(spark, sf).withColumn(
        "evolution_stage",
        F.when(F.col("source_id") % 500 < 3, F.concat(F.lit("stage"), (F.col("source_id") % 3).cast("string"))).otherwise(
            F.col("evolution_stage")
        ),
    )
    return G.label_violations(odd)


@query(
    "p10_duplicate_ids",
    twin("SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) > 1"),
)
def p10(spark, sf):
    return G.duplicate_ids(st.memberships(spark, sf))


@query(
    "p11_evolved_flag",
    twin("SELECT source_id, CASE WHEN is_evolved THEN 'evolved' ELSE 'dwarf' END AS evolution_stage FROM stars"),
)
def p11(spark, sf):
    return st.stars(spark, sf, "source_id", "is_evolved").select(
        "source_id", LB.stage_of_flag(F.col("is_evolved")).alias("evolution_stage")
    )


@query(
    "p13_refinement_frame",
    twin(
        f"""SELECT source_id, spec_class, label AS spec_subclass, CASE WHEN luminosity_class IN ('V', 'VI') THEN 'dwarf'
  WHEN luminosity_class IS NOT NULL THEN 'evolved' END AS evolution_stage, radius_flame AS radius_gspphot FROM (
  SELECT *, spectral_class || spectral_subclass AS label, count(*) OVER (PARTITION BY spectral_class || spectral_subclass) AS n FROM stars
  WHERE {CORE_PRESENT} AND radius_flame IS NOT NULL AND spectral_subclass IS NOT NULL) WHERE n >= 15"""
    ),
)
def p13(spark, sf):
    return FR.refinement_frame(stars(spark, sf)).select(
        "source_id", "spec_class", "spec_subclass", "evolution_stage", "radius_gspphot"
    )


@query(
    "p14_feature_aliases",
    twin("SELECT source_id, radius_flame, radius_flame AS radius_feature, radius_flame AS radius_gspphot FROM stars"),
)
def p14(spark, sf):
    return R.alias_features(
        st.stars(spark, sf, "source_id", "radius_flame"), ("radius_feature", "radius_gspphot")
    )


@query(
    "p15_family_frame",
    twin(
        f"""SELECT source_id, CAST(source_id % 10 AS VARCHAR) AS spectral_subclass, 'G' || (source_id % 10) AS full_subclass_label FROM stars
  WHERE spectral_class = 'G' AND source_id % 5 <> 4 AND {' AND '.join(f'{c} IS NOT NULL' for c in C.FAMILY_FEATURES)}"""
    ),
)
def p15(spark, sf):
    forms = F.expr(
        "CASE source_id % 5 WHEN 0 THEN CAST(source_id % 10 AS STRING) WHEN 1 THEN concat('g', CAST(source_id % 10 AS STRING)) "
        "WHEN 2 THEN concat(CAST(source_id % 10 AS STRING), '.0') WHEN 3 THEN concat(' ', CAST(source_id % 10 AS STRING)) ELSE 'K5' END"
    )
    family = with_full_label(stars(spark, sf).where("spectral_class = 'G'")).withColumn("spectral_subclass", forms)
    return FR.family_frame(family, "G").select("source_id", "spectral_subclass", "full_subclass_label")


@query(
    "p16_task_ready",
    twin("SELECT source_id, spec_subclass FROM stars WHERE spec_subclass IS NOT NULL"),
)
def p16(spark, sf):
    return FR.task_ready(st.stars(spark, sf, "source_id", "spec_subclass"), "spec_subclass")


STATES = ("pass", "unknown", "reject")


@query(
    "p17_uploaded_csv",
    twin(
        """SELECT 'blank' AS rule, 'source_id' AS column_name, CAST(0 AS BIGINT) AS n_rows UNION ALL
  SELECT 'blank', 'quality_state', count(*) FROM stars WHERE source_id % 9 = 0 UNION ALL
  SELECT 'blank', 'teff_gspphot', count(*) FROM stars WHERE source_id % 8 <> 1 AND teff_gspphot IS NULL UNION ALL
  SELECT 'not_numeric', 'teff_gspphot', count(*) FROM stars WHERE source_id % 8 = 1 UNION ALL
  SELECT 'bad_state', 'quality_state', count(*) FROM stars WHERE source_id % 9 = 0 OR source_id % 9 = 1"""
    ),
)
def p17(spark, sf):
    text = st.stars(spark, sf, "source_id", "teff_gspphot").select(
        F.col("source_id").cast("string").alias("source_id"),
        F.expr("CASE source_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'maybe' ELSE ' Pass' END").alias("quality_state"),
        F.expr("CASE WHEN source_id % 8 = 1 THEN '12k' ELSE CAST(teff_gspphot AS STRING) END").alias("teff_gspphot"),
    )
    return R.uploaded_csv_report(text, ("source_id", "quality_state", "teff_gspphot"), ("teff_gspphot",), STATES)


@query(
    "p21_router_predictions",
    twin("SELECT source_id, label AS spec_class, CASE WHEN is_evolved THEN 'evolved' ELSE 'dwarf' END AS evolution_stage FROM stars JOIN coarse USING (source_id)"),
)
def p21(spark, sf):
    from skysieve.operators.decision import summarise_probabilities
    from skysieve.plans.flows import adopt_router_predictions

    scored = summarise_probabilities(stars(spark, sf), st.CLASS_PROBABILITIES, "coarse").select(
        "source_id",
        F.lit("old").alias("spec_class"),
        F.col("coarse_predicted_label").alias("predicted_spec_class"),
        LB.stage_of_flag(F.col("is_evolved")).alias("predicted_evolution_stage"),
    )
    return adopt_router_predictions(scored).select("source_id", "spec_class", "evolution_stage")


@query(
    "p23_ob_scoring_frame",
    twin(
        "SELECT source_id, spec_class AS spectral_class, radius_flame AS radius_feature FROM stars WHERE spec_class IN ('O', 'B')"
    ),
)
def p23(spark, sf):
    from skysieve.operators.boundary import scoring_frame

    df = stars(spark, sf).drop("spectral_class").where("spec_class IN ('O', 'B')")
    return scoring_frame(df).select("source_id", "spectral_class", "radius_feature")


@query(
    "a01_label_support",
    twin(
        "SELECT source_id, spec_subclass FROM (SELECT *, count(*) OVER (PARTITION BY spec_subclass) AS n FROM stars "
        "WHERE spec_subclass IS NOT NULL) WHERE n >= 20"
    ),
)
def a01(spark, sf):
    return FR.keep_supported(st.stars(spark, sf, "source_id", "spec_subclass"), "spec_subclass", 20)


@query(
    "a35_collapsed_memberships",
    twin(
        f"""SELECT source_id, 'ood' AS domain_target, CASE WHEN count(DISTINCT ood_group) > 1 AND count(*) > 1 THEN 'multi_ood'
    ELSE arg_min(ood_group, random_index) END AS ood_group,
  CASE WHEN count(*) > 1 THEN string_agg(DISTINCT ood_group, ',' ORDER BY ood_group) END AS ood_group_members,
  max(ood_membership_count) AS ood_membership_count, CASE WHEN count(*) > 1 THEN true ELSE bool_or(has_multi_ood_membership) END AS has_multi_ood_membership,
  max(selector_score_1) AS selector_score_1, max(selector_score_2) AS selector_score_2, arg_min(teff_gspphot, random_index) AS teff_gspphot
  FROM members WHERE {CORE_PRESENT} GROUP BY source_id"""
    ),
)
def a35(spark, sf):
    return FR.ood_frame(st.memberships(spark, sf)).select(
        "source_id",
        "domain_target",
        "ood_group",
        "ood_group_members",
        "ood_membership_count",
        "has_multi_ood_membership",
        "selector_score_1",
        "selector_score_2",
        "teff_gspphot",
    )


@query(
    "w04_first_membership",
    twin(f"SELECT source_id, min(random_index) AS random_index FROM members WHERE {CORE_PRESENT} GROUP BY 1"),
)
def w04(spark, sf):
    return FR.ood_frame(st.memberships(spark, sf)).select("source_id", "random_index")


# --- samples and splits ---------------------------------------------------------------

# plain arithmetic so that both engines order rows alike
ORDER_SQL = "(source_id * 48271 + 42) % 2147483647"

VIEWS["coarse_rows"] = f"""
SELECT *, spec_class || '|' || CASE WHEN is_evolved THEN 'evolved' ELSE 'dwarf' END AS stratum, {ORDER_SQL} AS ord FROM stars WHERE {CORE_PRESENT}"""
VIEWS["quotas"] = """
SELECT stratum, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, stratum) <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test
FROM (SELECT *, floor(exact) AS base FROM (SELECT stratum, n, ceil(3E-1 * sum(n) OVER ()) AS n_test,
  ceil(3E-1 * sum(n) OVER ()) * n / CAST(sum(n) OVER () AS DOUBLE) AS exact FROM (SELECT stratum, count(*) AS n FROM coarse_rows GROUP BY 1)))"""
VIEWS["split_rows"] = """
SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY r.stratum ORDER BY ord, CAST(source_id AS VARCHAR)) <= q.n_test THEN 'test' ELSE 'train' END AS split_name
FROM coarse_rows r JOIN quotas q USING (stratum)"""


def coarse_frame(spark, sf):
    return FR.coarse_frame(L.coarse_training_view(stars(spark, sf)), check=False)


def coarse_split(spark, sf):
    return SM.stratified_split(coarse_frame(spark, sf), C.COARSE_TASK.strata, order_key=F.expr(ORDER_SQL))


@query("m16_stratified_split", twin("SELECT source_id, split_name FROM split_rows"))
def m16(spark, sf):
    return coarse_split(spark, sf).select("source_id", "split_name")


@query("m16_split_quotas", twin("SELECT * FROM quotas"))
def m16_quotas(spark, sf):
    return SM.split_quotas(coarse_frame(spark, sf), C.COARSE_TASK.strata)


@query(
    "m17_stratified_folds",
    twin(
        "SELECT source_id, CAST((row_number() OVER (PARTITION BY spec_class ORDER BY ord, CAST(source_id AS VARCHAR)) - 1) % 10 AS INT) AS fold FROM coarse_rows"
    ),
)
def m17(spark, sf):
    return SM.stratified_folds(coarse_frame(spark, sf), "spec_class", order_key=F.expr(ORDER_SQL)).select("source_id", "fold")


VIEWS["hosts"] = """SELECT *, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS stage FROM stars
WHERE source_id IN (SELECT c_custkey FROM customer) AND spec_class IN ('F', 'G', 'K', 'M') AND teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND radius_flame IS NOT NULL"""
VIEWS["router"] = """SELECT *, CASE WHEN evolution_stage = 'dwarf' THEN 'dwarf' ELSE 'evolved' END AS stage FROM stars
WHERE teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND radius_gspphot IS NOT NULL"""
VIEWS["pool"] = "SELECT * FROM router WHERE spec_class IN ('F', 'G', 'K', 'M') AND source_id NOT IN (SELECT source_id FROM hosts)"
VIEWS["field_sample"] = f"""
SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.spec_class, p.stage ORDER BY {ORDER_SQL}, CAST(source_id AS VARCHAR)) AS rn, h.need
FROM pool p JOIN (SELECT spec_class, stage, 2 * count(*) AS need FROM hosts GROUP BY 1, 2) h ON h.spec_class = p.spec_class AND h.stage = p.stage)
WHERE rn <= need"""


def host_side(spark, sf):
    """Stars with a known companion: the ids that the customer table holds."""
    known = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("source_id"))
    return FR.host_frame(stars(spark, sf).join(known, "source_id", "left_semi"), check=False)


def host_contract_side(spark, sf):
    return FR.host_frame(stars(spark, sf), check=False)


def router_side(spark, sf):
    return FR.router_frame(stars(spark, sf).drop("spec_subclass"), check=False)


@query("j11_field_pool", twin("SELECT source_id, spec_class, stage AS evolution_stage FROM pool"))
def j11(spark, sf):
    hosts = SM.target_hosts(host_side(spark, sf))
    return SM.field_pool(router_side(spark, sf), hosts).select("source_id", "spec_class", "evolution_stage")


@query("m15_matched_sample", twin("SELECT source_id, spec_class, stage AS evolution_stage FROM field_sample"))
def m15(spark, sf):
    hosts = SM.target_hosts(host_side(spark, sf))
    pool = SM.field_pool(router_side(spark, sf), hosts)
    return SM.matched_field_sample(pool, hosts, ratio=2, order_key=F.expr(ORDER_SQL)).select(
        "source_id", "spec_class", "evolution_stage"
    )


@query(
    "u01_host_field_dataset",
    twin(
        """SELECT source_id, spec_class, stage AS evolution_stage, radius_flame AS radius_gspphot, 'host' AS host_label FROM hosts
  UNION ALL SELECT source_id, spec_class, stage, radius_gspphot, 'field' FROM field_sample"""
    ),
)
def u01(spark, sf):
    return SM.host_field_dataset(
        host_side(spark, sf), router_side(spark, sf), ratio=2, order_key=F.expr(ORDER_SQL), check=False
    ).select("source_id", "spec_class", "evolution_stage", "radius_gspphot", "host_label")
