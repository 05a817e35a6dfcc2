"""Registered queries: matching, labelling, batches and working layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import layers as L
from skysieve.operators import linking as X
from skysieve.plans import bundles as B
from skysieve.plans import stars as st
from skysieve.plans.catalogue_queries import filtered
from skysieve.plans.registry import query
from skysieve.plans.twins import CORE, CORE_PRESENT, VIEWS, twin
from skysieve.session import materialise, scratch_path
from skysieve.sources import catalogue as cat

BATCH = "xmatch:demo_1"

VIEWS["matches"] = f"""
SELECT '{BATCH}' AS xmatch_batch_id, external_row_id, source_id, sep * 3600E0 AS xmatch_separation_arcsec,
  CAST(row_number() OVER (PARTITION BY external_row_id ORDER BY sep, source_id) AS INT) AS xmatch_rank,
  row_number() OVER (PARTITION BY external_row_id ORDER BY sep, source_id) = 1 AS xmatch_selected
FROM (SELECT external_row_id, source_id, min(SEPARATION) AS sep FROM cand GROUP BY 1, 2)"""
VIEWS["labeled"] = """
SELECT xmatch_batch_id, source_id, m.external_row_id, external_catalog_name, external_object_id, raw_sptype, spectral_class, spectral_subclass,
  luminosity_class, peculiarity_suffix, parse_status AS label_parse_status, parse_note AS label_parse_notes, xmatch_separation_arcsec,
  count(*) OVER (PARTITION BY source_id) > 1 AS has_source_conflict, count(*) OVER (PARTITION BY source_id) AS source_conflict_count
FROM matches m JOIN classified c ON c.external_row_id = m.external_row_id WHERE xmatch_selected AND outcome = 'filtered'"""
VIEWS["provenance"] = "SELECT * FROM gated WHERE quality_state = 'pass' AND spectral_class IN ('O', 'B', 'OB') AND teff_gspphot >= 1E4"
VIEWS["obrows"] = """
SELECT * EXCLUDE (spectral_class), CASE WHEN spectral_class = 'B' AND source_id % 2 = 0 THEN 'OB' ELSE spectral_class END AS spectral_class FROM stars"""
VIEWS["obpolicy"] = """
SELECT *, 'coarse_ob_boundary_policy_v1' AS ob_policy_version, CASE WHEN secure THEN 'secure_o_like' ELSE 'ob_boundary' END AS ob_policy_bucket,
  CASE WHEN secure THEN 'esphs_o_non999' WHEN spectral_class = 'OB' THEN 'ambiguous_ob_label' ELSE 'explicit_o_not_confirmed_by_esphs' END
    AS ob_policy_reason
FROM (SELECT *, coalesce(esphs_class_letter = 'O' AND coalesce(flags_esphs, -1) <> 999, false) AS secure FROM obrows
  WHERE spectral_class IN ('O', 'OB'))"""

_LABELED = {}


def matches(spark, sf):
    return X.rank_matches(st.candidates(spark, sf), BATCH)


def labeled(spark, sf):
    """The labelled layer is a table in its own right: written once, read by many queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LABELED:
        best = X.best_matches(st.candidates(spark, sf), BATCH)
        rows = X.label_rows(X.labeled_source(best, filtered(spark, sf), BATCH))
        _LABELED[key] = materialise(rows, "labeled")
    return _LABELED[key]


def ob_rows(spark, sf):
    df = st.stars(spark, sf)
    return df.withColumn(
        "spectral_class",
        F.when((F.col("spectral_class") == "B") & (F.col("source_id") % 2 == 0), "OB").otherwise(
            F.col("spectral_class")
        ),
    )


MOVED = {
    "external_row_id": "source_id",
    "ra_deg": "CASE WHEN source_id % 5 = 0 THEN NULL ELSE ra END",
    "dec_deg": "dec + ((source_id % 9) - 2) / 36E2",
}
MOVED_SQL = ", ".join(f"{e} AS {n}" for n, e in MOVED.items())


@query(
    "j01_sky_match",
    twin(
        f"""SELECT e.external_row_id, s.source_id, round(3600E0 * degrees(2E0 * asin(sqrt(pow(sin(radians(s.dec - e.dec_deg) / 2E0), 2)
  + cos(radians(s.dec)) * cos(radians(e.dec_deg)) * pow(sin(radians(s.ra - e.ra_deg) / 2E0), 2)))), 6) AS separation_arcsec
  FROM (SELECT {MOVED_SQL} FROM stars) e JOIN stars s ON s.dec BETWEEN e.dec_deg - 2E-3 AND e.dec_deg + 2E-3
  WHERE degrees(2E0 * asin(sqrt(pow(sin(radians(s.dec - e.dec_deg) / 2E0), 2)
  + cos(radians(s.dec)) * cos(radians(e.dec_deg)) * pow(sin(radians(s.ra - e.ra_deg) / 2E0), 2)))) <= 5E0 / 36E2"""
    ),
)
def j01(spark, sf):
    survey = st.stars(spark, sf, "source_id", "ra", "dec")
    moved = survey.select(*[F.expr(e).alias(n) for n, e in MOVED.items()])
    return X.sky_match(moved, survey).select(
        "external_row_id", "source_id", F.round(F.col("SEPARATION") * 3600.0, 6).alias("separation_arcsec")
    )


@query("w01_match_rank", twin("SELECT * FROM matches"))
def w01(spark, sf):
    return matches(spark, sf)


@query(
    "j02_labeled_source",
    twin(
        "SELECT xmatch_batch_id, source_id, external_row_id, external_object_id, raw_sptype, source_conflict_count FROM labeled"
    ),
)
def j02(spark, sf):
    best = X.best_matches(st.candidates(spark, sf), BATCH)
    return X.labeled_source(best, filtered(spark, sf), BATCH).select(
        "xmatch_batch_id",
        "source_id",
        "external_row_id",
        "external_object_id",
        "raw_sptype",
        "source_conflict_count",
    )


@query(
    "w02_conflict_count",
    twin(
        "SELECT external_row_id, source_id, count(*) OVER (PARTITION BY source_id) AS source_conflict_count "
        "FROM matches WHERE xmatch_selected"
    ),
)
def w02(spark, sf):
    rows = X.best_matches(st.candidates(spark, sf), BATCH).select("external_row_id", "source_id")
    return X.with_conflict_count(rows)


@query("l09_labeled_rows", twin(f"SELECT {', '.join(C.LABELED_COLUMNS)} FROM labeled"))
def l09(spark, sf):
    return labeled(spark, sf).select(*C.LABELED_COLUMNS)


@query(
    "a32_match_counts",
    twin(
        """SELECT count(*) AS rows_loaded, count(DISTINCT external_row_id) AS distinct_external_rows,
  count(*) FILTER (WHERE xmatch_selected) AS selected_rows,
  (SELECT count(*) FROM (SELECT 1 FROM matches GROUP BY external_row_id HAVING count(*) > 1)) AS multi_match_external_rows FROM matches"""
    ),
)
def a32(spark, sf):
    return X.match_counts(matches(spark, sf))


@query(
    "a33_labeled_counts",
    twin(
        """SELECT count(*) AS rows_loaded, count(DISTINCT source_id) AS distinct_source_ids, count(DISTINCT external_row_id) AS distinct_external_rows,
  (SELECT count(*) FROM (SELECT 1 FROM labeled GROUP BY source_id HAVING count(*) > 1)) AS duplicate_source_ids,
  count(*) FILTER (WHERE label_parse_status = 'parsed') AS parsed_rows, count(*) FILTER (WHERE label_parse_status = 'partial') AS partial_rows,
  count(*) FILTER (WHERE label_parse_status = 'unsupported') AS unsupported_rows, count(*) FILTER (WHERE label_parse_status = 'empty') AS empty_rows,
  count(*) FILTER (WHERE luminosity_class IS NULL) AS rows_without_luminosity_class FROM labeled"""
    ),
)
def a33(spark, sf):
    return X.labeled_counts(labeled(spark, sf))


@query(
    "s19_batch_overwrite",
    twin(
        "SELECT 'a' AS xmatch_batch_id, count(*) AS n_rows FROM matches "
        "UNION ALL SELECT 'b', count(*) FROM matches WHERE xmatch_selected"
    ),
)
def s19(spark, sf):
    path = scratch_path(spark, "crossmatch")
    rows = materialise(matches(spark, sf), "matches")
    X.write_batch(rows.withColumn("xmatch_batch_id", F.lit("a")), path)
    X.write_batch(rows.withColumn("xmatch_batch_id", F.lit("b")), path)
    X.write_batch(rows.where("xmatch_selected").withColumn("xmatch_batch_id", F.lit("b")), path)
    return spark.read.parquet(path).groupBy("xmatch_batch_id").agg(F.count("*").alias("n_rows"))


@query(
    "s21_enrichment_ids",
    twin("SELECT DISTINCT source_id FROM labeled WHERE NOT has_source_conflict"),
)
def s21(spark, sf):
    return X.enrichment_ids(labeled(spark, sf), BATCH)


VIEWS["ordered_ids"] = "SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS pos FROM (SELECT DISTINCT source_id FROM labeled)"


@query(
    "s22_batch_manifest",
    twin(
        """SELECT pos // 100 + 1 AS batch_index, count(*) AS rows_exported, min(source_id) AS source_id_min, max(source_id) AS source_id_max,
  'bmk_gaia_enrichment_batch_' || lpad(CAST(pos // 100 + 1 AS VARCHAR), 4, '0') || '.csv' AS csv_filename FROM ordered_ids GROUP BY pos // 100"""
    ),
)
def s22(spark, sf):
    ids = X.enrichment_ids(labeled(spark, sf), BATCH, only_conflict_free=False)
    batches = materialise(X.id_batches(ids, 100), "id-batches")
    X.export_batches(batches, scratch_path(spark, "id-batch-files"))
    return X.batch_manifest(batches)


@query("w05_batch_positions", twin("SELECT source_id, pos // 100 + 1 AS batch_index FROM ordered_ids"))
def w05(spark, sf):
    return X.id_batches(X.enrichment_ids(labeled(spark, sf), BATCH, only_conflict_free=False), 100)


@query("s23_labeled_export", twin(f"SELECT {', '.join(C.LABELED_COLUMNS)} FROM labeled"))
def s23(spark, sf):
    path = cat.write_csv(labeled(spark, sf), scratch_path(spark, "labeled-csv"), C.LABELED_COLUMNS)
    return cat.read_csv(spark, path, C.LABELED_COLUMNS)


@query(
    "j03_enrichment",
    twin(
        "SELECT source_id, radius_flame, lum_flame FROM (SELECT DISTINCT source_id FROM labeled) "
        "LEFT JOIN (SELECT * FROM stars WHERE source_id % 3 <> 0) USING (source_id)"
    ),
)
def j03(spark, sf):
    ids = X.enrichment_ids(labeled(spark, sf), BATCH, only_conflict_free=False)
    return L.enrich(ids, st.stars(spark, sf).where("source_id % 3 <> 0"), "radius_flame", "lum_flame")


VIEWS["reference_rows"] = f"""
SELECT l.*, {', '.join(f's.{c}' for c in CORE)}, f.radius_flame, ({CORE_PRESENT}) AS has_core_features, f.radius_flame IS NOT NULL AS has_flame_features
FROM (SELECT * FROM labeled WHERE NOT has_source_conflict OR source_conflict_count < 4) l LEFT JOIN stars s USING (source_id)
LEFT JOIN (SELECT source_id, radius_flame FROM stars WHERE source_id % 3 <> 0) f USING (source_id)"""


def reference(spark, sf):
    loose = labeled(spark, sf).withColumn(
        "has_source_conflict", F.col("has_source_conflict") & (F.col("source_conflict_count") >= 4)
    )
    flame = st.stars(spark, sf).where("source_id % 3 <> 0").select("source_id", "radius_flame")
    return L.training_reference(loose, st.stars(spark, sf, "source_id", *CORE), flame)


@query(
    "j04_training_reference",
    twin(
        "SELECT source_id, external_row_id, spectral_class, teff_gspphot, radius_flame, has_core_features, has_flame_features FROM reference_rows"
    ),
)
def j04(spark, sf):
    return reference(spark, sf).select(
        "source_id",
        "external_row_id",
        "spectral_class",
        "teff_gspphot",
        "radius_flame",
        "has_core_features",
        "has_flame_features",
    )


@query(
    "a25_training_summary",
    twin(
        """SELECT spectral_class, count(*) AS row_count, count(spectral_subclass) AS subclass_rows, count(luminosity_class) AS luminosity_rows,
  count(*) FILTER (WHERE has_core_features) AS core_feature_rows, count(*) FILTER (WHERE has_flame_features) AS flame_feature_rows,
  count(*) FILTER (WHERE label_parse_status = 'parsed') AS parsed_rows, count(*) FILTER (WHERE label_parse_status = 'partial') AS partial_rows
  FROM reference_rows GROUP BY spectral_class"""
    ),
)
def a25(spark, sf):
    return L.training_summary(reference(spark, sf))


@query(
    "j05_parser_sync",
    twin(
        """SELECT external_row_id, CASE WHEN external_row_id % 5 = 1 THEN 'stale' ELSE spectral_class END AS spectral_class,
  spectral_subclass, label_parse_status, external_row_id % 7 = 0 AND external_row_id % 5 <> 1 AS is_updated FROM labeled"""
    ),
)
def j05(spark, sf):
    truth = labeled(spark, sf)
    row = F.col("external_row_id")
    stale = truth.withColumns(
        {
            "spectral_class": F.when((row % 7 == 0) | (row % 5 == 1), "stale").otherwise(
                F.col("spectral_class")
            ),
            "external_catalog_name": F.when(row % 5 == 1, "other").otherwise(
                F.col("external_catalog_name")
            ),
        }
    )
    return L.sync_parser_fields(stale, truth).select(
        "external_row_id", "spectral_class", "spectral_subclass", "label_parse_status", "is_updated"
    )


@query(
    "a27_sync_summary",
    twin(
        """SELECT count(*) FILTER (WHERE c = 'O' AND regexp_matches(raw_sptype, '^(OB|O/B|O[0-9]+([.][0-9]+)?/B)')) AS ambiguous_ob_rows,
  count(*) FILTER (WHERE c = 'OB') AS ob_rows, count(*) FILTER (WHERE c = 'O') AS o_rows
  FROM (SELECT raw_sptype, CASE WHEN source_id % 2 = 0 THEN 'O' ELSE spectral_class END AS c FROM parse_result)"""
    ),
)
def a27(spark, sf):
    from skysieve.functions.labels import parse_label

    rows = st.stars(spark, sf, "source_id", "raw_sptype").select(
        "raw_sptype",
        F.when(F.col("source_id") % 2 == 0, "O")
        .otherwise(parse_label(F.col("raw_sptype"))["spectral_class"])
        .alias("spectral_class"),
    )
    return L.sync_summary(rows)


@query(
    "j06_provenance_sync",
    twin(
        """SELECT s.source_id, CASE WHEN p.source_id IS NULL THEN 0E0 ELSE p.ruwe END AS ruwe,
  CASE WHEN p.source_id IS NULL THEN 'old' ELSE p.quality_state END AS quality_state, p.source_id IS NOT NULL AS is_updated
  FROM stars s LEFT JOIN provenance p USING (source_id)"""
    ),
)
def j06(spark, sf):
    audit = st.stars(spark, sf, "source_id").withColumns(
        {"ruwe": F.lit(0.0), "quality_state": F.lit("old")}
    )
    return L.sync_provenance(audit, L.hot_ob_source(B.gated(spark, sf)))


@query(
    "d19_hot_ob_source",
    twin("SELECT source_id, spectral_class, quality_state, teff_gspphot, random_index FROM provenance"),
)
def d19(spark, sf):
    return L.hot_ob_source(B.gated(spark, sf)).select(
        "source_id", "spectral_class", "quality_state", "teff_gspphot", "random_index"
    )


FAMILY_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in C.FAMILY_FEATURES)
VIEWS["audit_rows"] = """
SELECT spectral_class, spectral_class || spectral_subclass AS full_subclass, count(*) AS n_rows, count(*) >= 15 AS keep_ge_15
FROM gated WHERE spectral_subclass IS NOT NULL AND quality_state = 'pass' GROUP BY ALL"""
VIEWS["families"] = f"""
SELECT g.*, g.spectral_class || g.spectral_subclass AS full_subclass_label FROM gated g JOIN audit_rows a
  ON a.spectral_class = g.spectral_class AND a.full_subclass = g.spectral_class || g.spectral_subclass AND keep_ge_15
WHERE g.spectral_class <> 'O' AND quality_state = 'pass' AND ood_state = 'in_domain' AND {FAMILY_PRESENT}"""


def families(spark, sf):
    gated = B.gated(spark, sf)
    return L.family_training_rows(gated, L.support_audit(gated.where("quality_state = 'pass'")))


@query("a02_support_audit", twin("SELECT * FROM audit_rows"))
def a02(spark, sf):
    return L.support_audit(B.gated(spark, sf).where("quality_state = 'pass'"))


@query("j07_family_rows", twin("SELECT source_id, spectral_class, full_subclass_label FROM families"))
def j07(spark, sf):
    return families(spark, sf).select("source_id", "spectral_class", "full_subclass_label")


@query(
    "a34_family_summary",
    twin(
        """SELECT spectral_class, count(*) AS rows_loaded, count(DISTINCT source_id) AS distinct_source_ids,
  count(DISTINCT spectral_subclass) AS distinct_subclasses FROM families GROUP BY 1"""
    ),
)
def a34(spark, sf):
    return L.family_summary(families(spark, sf))


@query(
    "a26_state_summary",
    twin("SELECT quality_state, ood_state, count(*) AS row_count FROM gated GROUP BY ALL"),
)
def a26(spark, sf):
    return L.state_summary(B.gated(spark, sf))


@query(
    "a26_bucket_summary",
    twin(
        "SELECT review_bucket, count(*) AS row_count FROM gated WHERE quality_state <> 'pass' OR ood_state <> 'in_domain' GROUP BY ALL"
    ),
)
def a26_bucket(spark, sf):
    return L.bucket_summary(L.review_rows(B.gated(spark, sf)))


@query(
    "u06_ob_policy_split",
    twin("SELECT source_id, spectral_class, ob_policy_version, ob_policy_bucket, ob_policy_reason FROM obpolicy"),
)
def u06(spark, sf):
    return L.ob_policy(ob_rows(spark, sf)).select(
        "source_id", "spectral_class", "ob_policy_version", "ob_policy_bucket", "ob_policy_reason"
    )


@query(
    "a28_ob_policy_summary",
    twin(
        """SELECT ob_policy_bucket, spectral_class AS local_spectral_class, count(*) AS n_rows,
  count(*) FILTER (WHERE esphs_class_letter = 'O') AS n_esphs_o, count(*) FILTER (WHERE esphs_class_letter = 'B') AS n_esphs_b,
  count(*) FILTER (WHERE esphs_class_letter = 'U') AS n_esphs_u, quantile_cont(teff_esphs, 5E-1) AS median_teff_esphs
  FROM obpolicy GROUP BY 1, 2"""
    ),
)
def a28(spark, sf):
    return L.ob_policy_summary(L.ob_policy(ob_rows(spark, sf)))


@query(
    "d20_ob_review_pool",
    twin(
        """SELECT source_id, 'review' AS ob_review_state, ob_policy_reason AS ob_review_reason FROM obpolicy
  WHERE ob_policy_bucket = 'ob_boundary'"""
    ),
)
def d20(spark, sf):
    return L.ob_review_pool(L.ob_policy(ob_rows(spark, sf))).select(
        "source_id", "ob_review_state", "ob_review_reason"
    )


@query(
    "a31_ob_review_summary",
    twin(
        """SELECT spectral_class AS local_spectral_class, ob_policy_reason AS ob_review_reason, esphs_class_letter, count(*) AS n_rows,
  quantile_cont(teff_esphs, 5E-1) AS median_teff_esphs FROM obpolicy WHERE ob_policy_bucket = 'ob_boundary' GROUP BY 1, 2, 3"""
    ),
)
def a31(spark, sf):
    return L.ob_review_summary(L.ob_review_pool(L.ob_policy(ob_rows(spark, sf))))


@query(
    "a29_provenance_summary",
    twin(
        """SELECT spectral_class, count(*) AS n_rows, count(*) FILTER (WHERE in_gold_sample_oba_stars) AS n_in_gold_sample_oba_stars,
  count(spectraltype_esphs) AS n_with_esphs_type, count(*) FILTER (WHERE esphs_class_letter = 'O') AS n_esphs_o,
  count(*) FILTER (WHERE esphs_class_letter = 'B') AS n_esphs_b, count(*) FILTER (WHERE esphs_class_letter = 'A') AS n_esphs_a,
  avg(CASE WHEN in_gold_sample_oba_stars THEN 1E0 ELSE 0E0 END) AS gold_sample_share,
  avg(CASE WHEN esphs_class_letter = 'O' THEN 1E0 ELSE 0E0 END) AS esphs_o_share,
  avg(CASE WHEN esphs_class_letter = 'B' THEN 1E0 ELSE 0E0 END) AS esphs_b_share,
  avg(CASE WHEN esphs_class_letter = 'A' THEN 1E0 ELSE 0E0 END) AS esphs_a_share,
  quantile_cont(teff_gspphot, 5E-1) AS median_teff_gspphot, quantile_cont(teff_esphs, 5E-1) AS median_teff_esphs,
  round(quantile_cont(radius_flame, 5E-1), 6) AS median_radius_flame, round(quantile_cont(radius_gspphot, 5E-1), 6) AS median_radius_gspphot
  FROM obrows WHERE teff_gspphot >= 1E4 GROUP BY 1"""
    ),
)
def a29(spark, sf):
    out = L.provenance_summary(ob_rows(spark, sf).where("teff_gspphot >= 10000"))
    return out.withColumns({c: F.round(c, 6) for c in ("median_radius_flame", "median_radius_gspphot")})


@query(
    "a30_crosswalk_summary",
    twin(
        """SELECT spectral_class, esphs_class_letter, count(*) AS n_rows, CAST(sum(count(*)) OVER (PARTITION BY spectral_class) AS BIGINT) AS n_local_class_rows,
  count(*) / sum(count(*)) OVER (PARTITION BY spectral_class) AS share_within_local_class,
  count(*) FILTER (WHERE in_gold_sample_oba_stars) AS n_in_gold_sample_oba_stars, quantile_cont(teff_gspphot, 5E-1) AS median_teff_gspphot,
  quantile_cont(teff_esphs, 5E-1) AS median_teff_esphs, round(quantile_cont(radius_flame, 5E-1), 6) AS median_radius_flame
  FROM obrows WHERE teff_gspphot >= 1E4 GROUP BY 1, 2"""
    ),
)
def a30(spark, sf):
    out = L.crosswalk_summary(ob_rows(spark, sf).where("teff_gspphot >= 10000"))
    return out.withColumn("median_radius_flame", F.round("median_radius_flame", 6))


@query(
    "d21_coarse_view",
    twin(
        f"SELECT source_id, spec_class, coalesce(radius_flame, radius_gspphot) AS radius_feature FROM stars WHERE {CORE_PRESENT}"
    ),
)
def d21(spark, sf):
    return L.coarse_training_view(st.stars(spark, sf)).select("source_id", "spec_class", "radius_feature")


@query(
    "d22_refinement_view",
    twin(
        """SELECT source_id, spectral_class, spectral_subclass FROM (SELECT *, count(*) OVER (PARTITION BY spectral_class, spectral_subclass) AS n
  FROM gated WHERE quality_state = 'pass' AND ood_state = 'in_domain' AND spectral_subclass IS NOT NULL AND has_core_features
  AND has_flame_features) WHERE n >= 15"""
    ),
)
def d22(spark, sf):
    return L.refinement_training_view(B.gated(spark, sf)).select(
        "source_id", "spectral_class", "spectral_subclass"
    )


@query(
    "u05_id_ood_view",
    twin(
        f"""SELECT source_id, 'id' AS domain_target, teff_gspphot, CAST(NULL AS VARCHAR) AS ood_group, random_index FROM gated
  WHERE quality_state = 'pass' AND ood_state = 'in_domain'
  UNION ALL SELECT source_id, 'ood', teff_gspphot, ood_group, random_index FROM members WHERE {CORE_PRESENT}"""
    ),
)
def u05(spark, sf):
    return L.id_ood_training_view(B.gated(spark, sf), st.memberships(spark, sf)).select(
        "source_id", "domain_target", "teff_gspphot", "ood_group", "random_index"
    )
