"""Registered queries: evaluation of given scores, O/B boundary and class O reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import boundary as O
from skysieve.operators import evaluation as E
from skysieve.operators import layers as L
from skysieve.operators.decision import summarise_probabilities
from skysieve.operators.distributions import distribution, group_distribution
from skysieve.plans import bundles as B
from skysieve.plans import stars as st
from skysieve.plans.frame_queries import coarse_split
from skysieve.plans.linking_queries import labeled, ob_rows
from skysieve.plans.registry import query
from skysieve.plans.review_queries import q50, rounded
from skysieve.plans.twins import CORE_PRESENT, VIEWS, dist_sql, twin
from skysieve.sources import relations as R

CLASSES = tuple("OBAFGKM")

VIEWS["preds"] = """
SELECT s.*, c.label AS predicted, c.pmax AS coarse_probability_max, c.margin AS coarse_probability_margin,
  CASE WHEN source_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_name FROM stars s JOIN coarse c USING (source_id)"""


def predictions(spark, sf):
    scored = summarise_probabilities(st.stars(spark, sf), st.CLASS_PROBABILITIES, "coarse")
    return scored.withColumn(
        "split_name", F.when(F.col("source_id") % 3 == 0, "test").otherwise("train")
    )


@query(
    "e01_classification_metrics",
    twin(
        """SELECT split_name, CAST(sum(support) AS BIGINT) AS n_rows, count(*) FILTER (WHERE support > 0) AS n_classes, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(r) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1
  FROM (SELECT *, coalesce(tp / nullif(called, 0), 0E0) AS p, coalesce(tp / nullif(support, 0), 0E0) AS r, coalesce(2E0 * tp / nullif(support + called, 0), 0E0) AS f FROM (
  SELECT split_name, c AS label, count(*) FILTER (WHERE spec_class = c) AS support, count(*) FILTER (WHERE predicted = c) AS called,
  count(*) FILTER (WHERE spec_class = c AND predicted = c) AS tp FROM preds, unnest(['O', 'B', 'A', 'F', 'G', 'K', 'M']) t(c) GROUP BY 1, 2)) GROUP BY 1"""
    ),
)
def e01(spark, sf):
    out = E.classification_metrics(predictions(spark, sf), "spec_class", "coarse_predicted_label")
    return rounded(out, "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


def auc_sql(view: str, value: str, hit: str, by: str) -> str:
    """Rank-sum AUC with mean ranks for ties."""
    return f"""SELECT {by}, (sum(rk) FILTER (WHERE hit) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2E0)
  / (count(*) FILTER (WHERE hit) * CAST(count(*) FILTER (WHERE NOT hit) AS DOUBLE)) AS auc, count(*) AS n FROM (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2E0 AS rk FROM (
  SELECT *, {value} AS v, {hit} AS hit FROM {view}) WHERE v IS NOT NULL) GROUP BY {by}"""


_LONG = " UNION ALL ".join(f"SELECT split_name, '{c}' AS label, p_{c} AS p, spec_class = '{c}' AS h FROM preds" for c in CLASSES)


@query(
    "e02_ovr_auc",
    twin(f"SELECT split_name, round(avg(auc), 6) AS roc_auc_ovr FROM ({auc_sql(f'({_LONG})', 'p', 'h', 'split_name, label')}) GROUP BY 1"),
)
def e02(spark, sf):
    return rounded(E.ovr_auc(predictions(spark, sf), "spec_class", st.CLASS_PROBABILITIES), "roc_auc_ovr")


@query(
    "e02_binary_auc",
    twin(
        f"""SELECT split_name, round(auc, 6) AS roc_auc_ovr FROM ({auc_sql("(SELECT *, CASE WHEN source_id % 7 < 3 THEN 'ood' ELSE 'id' END AS t FROM preds)",
        "ood_probability", "t = 'ood'", "split_name")})"""
    ),
)
def e02_binary(spark, sf):
    df = predictions(spark, sf).withColumns(
        {"t": F.expr("CASE WHEN source_id % 7 < 3 THEN 'ood' ELSE 'id' END"), "id_p": 1.0 - F.col("ood_probability")}
    )
    return rounded(E.ovr_auc(df, "t", {"id": "id_p", "ood": "ood_probability"}), "roc_auc_ovr")


VIEWS["binrows"] = """SELECT CAST(coalesce(spec_class IN ('G', 'K'), false) AS INT) AS y, host_similarity_score AS p, spec_class, evolution_stage,
  CASE WHEN source_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_name FROM stars WHERE host_similarity_score IS NOT NULL"""


def hosts(spark, sf):
    return st.stars(spark, sf).withColumns(
        {
            "host_label": F.when(F.col("spec_class").isin("G", "K"), "host").otherwise("field"),
            "split_name": F.when(F.col("source_id") % 3 == 0, "test").otherwise("train"),
        }
    )


def binary(spark, sf):
    return E.binary_rows(hosts(spark, sf), "host_label", "host_similarity_score", "host")


@query(
    "e04_calibration_summary",
    twin(
        f"""SELECT n_rows, positive_rate, mean_predicted_probability, brier_score, log_loss, (SELECT round(auc, 6) FROM ({auc_sql('(SELECT *, 1 AS g FROM binrows)', 'p', 'y = 1', 'g')})) AS roc_auc
  FROM (SELECT count(*) AS n_rows, round(avg(y), 6) AS positive_rate, round(avg(p), 6) AS mean_predicted_probability, round(avg((p - y) * (p - y)), 6) AS brier_score,
  round(avg(-CASE WHEN y = 1 THEN ln(greatest(p, 1E-15)) ELSE ln(1E0 - least(p, 1E0 - 1E-15)) END), 6) AS log_loss FROM binrows)"""
    ),
)
def e04(spark, sf):
    return rounded(
        E.calibration_summary(binary(spark, sf)),
        "positive_rate", "mean_predicted_probability", "brier_score", "log_loss", "roc_auc",
    )


_EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10))


@query(
    "e05_calibration_curve",
    twin(
        f"""SELECT CAST(row_number() OVER (ORDER BY b) AS INT) AS bin_index, m AS mean_predicted_probability, f AS fraction_of_positives FROM (
  SELECT len(list_filter(e, lambda x: x < p)) AS b, round(avg(p), 6) AS m, round(avg(y), 6) AS f FROM binrows, (SELECT [{_EDGES}] AS e FROM binrows) GROUP BY 1)"""
    ),
)
def e05(spark, sf):
    return rounded(E.calibration_curve(binary(spark, sf)), "mean_predicted_probability", "fraction_of_positives")


@query(
    "e05_uniform_curve",
    twin(
        """SELECT CAST(row_number() OVER (ORDER BY b) AS INT) AS bin_index, m AS mean_predicted_probability, f AS fraction_of_positives FROM (
  SELECT len(list_filter([2E-1, 4E-1, 6E-1, 8E-1], lambda x: x < p)) AS b, round(avg(p), 6) AS m, round(avg(y), 6) AS f FROM binrows GROUP BY 1)"""
    ),
)
def e05_uniform(spark, sf):
    return rounded(
        E.calibration_curve(binary(spark, sf), 5, "uniform"), "mean_predicted_probability", "fraction_of_positives"
    )


@query(
    "e06_probability_bins",
    twin(
        """SELECT probability_bin, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share, round(avg(y), 6) AS positive_rate, round(avg(p), 6) AS mean_probability
  FROM (SELECT y, p, CASE WHEN p <= 0 THEN NULL ELSE '(' || CAST((ceil(p * 10) - 1) / 10 AS VARCHAR) || ', ' || CAST(ceil(p * 10) / 10 AS VARCHAR) || ']' END AS probability_bin
  FROM (SELECT y, CASE WHEN p < 1E-1 THEN 0E0 ELSE p END AS p FROM binrows)) GROUP BY 1"""
    ),
)
def e06(spark, sf):
    rows = binary(spark, sf).withColumn("p", F.when(F.col("p") < 0.1, 0.0).otherwise(F.col("p")))
    return rounded(E.probability_bins(rows), "positive_rate", "mean_probability")


@query(
    "e07_calibration_by_class",
    twin(
        f"""SELECT spec_class, count(*) AS n_rows, round(avg(y), 6) AS positive_rate, round(avg(p), 6) AS mean_host_similarity_score,
  {q50('p')} AS median_host_similarity_score FROM binrows GROUP BY 1"""
    ),
)
def e07(spark, sf):
    out = E.calibration_by_group(hosts(spark, sf), "spec_class", "host_label", "host_similarity_score", "host")
    return rounded(out, "positive_rate", "mean_host_similarity_score", "median_host_similarity_score")


@query(
    "e08_split_summary",
    twin(
        """SELECT count(*) AS n_rows_full, count(*) FILTER (WHERE source_id % 3 <> 0) AS n_rows_train, count(*) FILTER (WHERE source_id % 3 = 0) AS n_rows_test,
  round(avg(CAST(spec_class IN ('G', 'K') AS INT)) FILTER (WHERE source_id % 3 <> 0), 6) AS train_positive_rate,
  round(avg(CAST(spec_class IN ('G', 'K') AS INT)) FILTER (WHERE source_id % 3 = 0), 6) AS test_positive_rate FROM stars"""
    ),
)
def e08(spark, sf):
    return rounded(
        E.split_summary(hosts(spark, sf), "host_label", "host"), "train_positive_rate", "test_positive_rate"
    )


@query(
    "m13_threshold_table",
    twin(
        """SELECT k, count(*) FILTER (WHERE t = 1) AS tp, count(*) FILTER (WHERE t = 0) AS fp, round((count(*) FILTER (WHERE t = 1) / max(np)
  + (max(nn) - count(*) FILTER (WHERE t = 0)) / max(nn)) / 2E0, 6) AS balanced_accuracy
  FROM (SELECT range AS k FROM range(100)) g LEFT JOIN (SELECT ood_probability AS p, CAST(source_id % 7 < 3 AS INT) AS t FROM stars) ON p >= k * (1E0 / 99E0),
  (SELECT count(*) FILTER (WHERE source_id % 7 < 3) AS np, count(*) FILTER (WHERE source_id % 7 >= 3) AS nn FROM stars) GROUP BY k"""
    ),
)
def m13(spark, sf):
    df = st.stars(spark, sf).withColumn("t", F.expr("CASE WHEN source_id % 7 < 3 THEN 'ood' ELSE 'id' END"))
    table = E.threshold_table(E.binary_rows(df, "t", "ood_probability", "ood"))
    return rounded(table, "balanced_accuracy").select(
        F.round(F.col("threshold") * 99).cast("long").alias("k"), "tp", "fp", "balanced_accuracy"
    )


# --- O/B boundary ---------------------------------------------------------------------

VIEWS["train_ob"] = f"""SELECT *, 'train_time' AS domain_name, coalesce(radius_flame, radius_gspphot) AS radius_feature FROM stars
WHERE spec_class IN ('O', 'B') AND teff_gspphot >= 1E4 AND {CORE_PRESENT}"""
VIEWS["downstream_ob"] = """SELECT *, 'downstream_pass' AS domain_name, radius_flame AS radius_feature FROM gated
WHERE spectral_class IN ('O', 'B') AND quality_state = 'pass' AND teff_gspphot >= 1E4"""
_F = "source_id, domain_name, spectral_class, teff_gspphot, logg_gspphot, mh_gspphot, bp_rp, parallax, parallax_over_error, ruwe, radius_feature, radius_flame, p_O, p_B"
VIEWS["domains"] = f"SELECT {_F} FROM train_ob UNION ALL SELECT {_F} FROM downstream_ob"
VIEWS["scored_domains"] = """SELECT d.*, c.label AS coarse_predicted_label, c.pmax AS coarse_probability_max, c.margin AS coarse_probability_margin
FROM domains d JOIN coarse c USING (source_id)"""


def train_ob(spark, sf):
    return O.train_boundary(L.coarse_training_view(st.stars(spark, sf)))


def downstream_ob(spark, sf):
    return O.downstream_boundary(R.hot_boundary_rows(B.gated(spark, sf)))


def domains(spark, sf):
    return O.both_domains(train_ob(spark, sf), downstream_ob(spark, sf))


def scored_domains(spark, sf):
    scored = summarise_probabilities(domains(spark, sf), st.CLASS_PROBABILITIES, "coarse")
    return scored.withColumns(
        {"coarse_probability__O": F.col("p_O"), "coarse_probability__B": F.col("p_B")}
    )


@query("u02_domain_union", twin("SELECT source_id, domain_name, spectral_class, radius_feature FROM domains"))
def u02(spark, sf):
    return domains(spark, sf).select("source_id", "domain_name", "spectral_class", "radius_feature")


@query(
    "a40_domain_class_balance",
    twin(
        """SELECT domain_name, spectral_class AS true_spectral_class, count(*) AS n_rows, count(*) / sum(count(*)) OVER (PARTITION BY domain_name) AS share_within_group
  FROM domains GROUP BY 1, 2"""
    ),
)
def a40(spark, sf):
    return group_distribution(domains(spark, sf), "domain_name", "spectral_class", "true_spectral_class")


@query(
    "a40_predicted_balance",
    twin(
        """SELECT domain_name, coarse_predicted_label, count(*) AS n_rows, count(*) / sum(count(*)) OVER (PARTITION BY domain_name) AS share_within_group
  FROM scored_domains GROUP BY 1, 2"""
    ),
)
def a40_predicted(spark, sf):
    return group_distribution(scored_domains(spark, sf), "domain_name", "coarse_predicted_label")


@query(
    "w03_confusion_share",
    twin(
        """SELECT domain_name, spectral_class AS true_spectral_class, coarse_predicted_label, count(*) AS n_rows,
  count(*) / sum(count(*)) OVER (PARTITION BY domain_name, spectral_class) AS share_within_true_class FROM scored_domains GROUP BY 1, 2, 3"""
    ),
)
def w03(spark, sf):
    return O.confusion_shares(scored_domains(spark, sf))


@query(
    "a41_probability_summary",
    twin(
        f"""SELECT domain_name, spectral_class AS true_spectral_class, count(*) AS n_rows, {q50('p_O')} AS median_probability__O, {q50('p_B')} AS median_probability__B,
  round(avg(p_O), 6) AS mean_probability__O, round(avg(p_B), 6) AS mean_probability__B FROM scored_domains GROUP BY 1, 2"""
    ),
)
def a41(spark, sf):
    names = [f"{a}_probability__{b}" for a in ("median", "mean") for b in "OB"]
    return rounded(O.probability_summary(scored_domains(spark, sf)), *names)


@query(
    "a42_physics_summary",
    twin(
        "SELECT domain_name, spectral_class, count(*) AS n_rows, "
        + ", ".join(f"{q50(c)} AS median_{c}" for c in O.PHYSICS)
        + " FROM domains GROUP BY 1, 2"
    ),
)
def a42(spark, sf):
    out = O.physics_summary(domains(spark, sf), ["domain_name", "spectral_class"])
    return rounded(out, *[f"median_{c}" for c in O.PHYSICS])


_GAPS = " UNION ALL ".join(
    f"SELECT domain_name, spectral_class, '{c}' AS feature_name, count(*) AS n_rows, round(avg(CAST({c} IS NULL AS INT)), 9) AS missing_share FROM domains GROUP BY 1, 2"
    for c in C.COARSE_FEATURES
)


@query("a43_missing_shares", twin(_GAPS))
def a43(spark, sf):
    return rounded(O.missing_shares(domains(spark, sf), ["domain_name", "spectral_class"]), "missing_share", digits=9)


@query(
    "a52_missing_gap",
    twin(
        f"""SELECT spectral_class, feature_name, max(missing_share) FILTER (WHERE domain_name = 'train_time') AS train_time,
  max(missing_share) FILTER (WHERE domain_name = 'downstream_pass') AS downstream_pass,
  round(max(missing_share) FILTER (WHERE domain_name = 'downstream_pass') - max(missing_share) FILTER (WHERE domain_name = 'train_time'), 8) AS missing_gap
  FROM ({_GAPS}) GROUP BY 1, 2"""
    ),
)
def a52(spark, sf):
    out = rounded(O.missing_gap(domains(spark, sf)), "train_time", "downstream_pass", digits=9)
    return rounded(out, "missing_gap", digits=8)


_SHIFT = " UNION ALL ".join(
    f"SELECT spectral_class AS true_spectral_class, '{c}' AS feature_name, domain_name, {c} AS value FROM domains" for c in C.COARSE_FEATURES
)


@query(
    "e10_domain_shift_auc",
    twin(
        f"""SELECT true_spectral_class, feature_name, n AS n_rows_used, round(auc, 6) AS auc_ovr_downstream, round(greatest(auc, 1E0 - auc), 6) AS separability_auc,
  CASE WHEN auc >= 5E-1 THEN 'downstream_pass' ELSE 'train_time' END AS higher_value_domain, mt AS median_train_time, md AS median_downstream_pass
  FROM ({auc_sql(f'({_SHIFT})', 'value', "domain_name = 'downstream_pass'", 'true_spectral_class, feature_name')}) JOIN (
  SELECT true_spectral_class, feature_name, round(quantile_cont(value, 5E-1) FILTER (WHERE domain_name = 'train_time'), 6) AS mt,
  round(quantile_cont(value, 5E-1) FILTER (WHERE domain_name = 'downstream_pass'), 6) AS md FROM ({_SHIFT}) GROUP BY 1, 2) USING (true_spectral_class, feature_name)
  WHERE auc IS NOT NULL AND NOT isnan(auc)"""
    ),
)
def e10(spark, sf):
    return rounded(
        O.domain_shift_auc(domains(spark, sf)),
        "auc_ovr_downstream", "separability_auc", "median_train_time", "median_downstream_pass",
    )


_CLS = " UNION ALL ".join(f"SELECT '{c}' AS feature_name, spec_class, {c} AS value FROM train_ob" for c in C.COARSE_FEATURES)


@query(
    "e11_class_separability",
    twin(
        f"""SELECT feature_name, n AS n_rows_used, round(auc, 6) AS auc_ovr_o, round(greatest(auc, 1E0 - auc), 6) AS separability_auc,
  CASE WHEN auc >= 5E-1 THEN 'O' ELSE 'B' END AS higher_value_class, round(mo, 6) AS median_o, round(mb, 6) AS median_b, round(mo - mb, 6) AS median_gap
  FROM ({auc_sql(f'({_CLS})', 'value', "spec_class = 'O'", 'feature_name')}) JOIN (SELECT feature_name, quantile_cont(value, 5E-1) FILTER (WHERE spec_class = 'O') AS mo,
  quantile_cont(value, 5E-1) FILTER (WHERE spec_class = 'B') AS mb FROM ({_CLS}) GROUP BY 1) USING (feature_name)"""
    ),
)
def e11(spark, sf):
    return rounded(
        O.class_separability_auc(train_ob(spark, sf)),
        "auc_ovr_o", "separability_auc", "median_o", "median_b", "median_gap",
    )


@query(
    "k06_o_called_b",
    twin(
        """SELECT source_id, coarse_probability_max, coarse_probability_margin, teff_gspphot FROM scored_domains WHERE domain_name = 'train_time'
  AND spectral_class = 'O' AND coarse_predicted_label = 'B' ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20"""
    ),
)
def k06(spark, sf):
    rows = scored_domains(spark, sf).where("domain_name = 'train_time'")
    return O.confident_errors(rows, O.called("O", "B")).select(
        "source_id", "coarse_probability_max", "coarse_probability_margin", "teff_gspphot"
    )


@query(
    "k06_not_called_o",
    twin(
        """SELECT source_id, spectral_class, coarse_predicted_label, coarse_probability_max FROM scored_domains WHERE domain_name = 'downstream_pass'
  AND coarse_predicted_label <> 'O' ORDER BY coarse_probability_max DESC, coarse_probability_margin DESC, 1 LIMIT 20"""
    ),
)
def k06_not_o(spark, sf):
    rows = scored_domains(spark, sf).where("domain_name = 'downstream_pass'")
    return O.confident_errors(rows, O.not_called("O")).select(
        "source_id", "spectral_class", "coarse_predicted_label", "coarse_probability_max"
    )


@query(
    "k06_b_called_o",
    twin(
        """SELECT source_id, coarse_probability_max, coarse_probability_margin, teff_gspphot FROM scored_domains WHERE domain_name = 'train_time'
  AND spectral_class = 'B' AND coarse_predicted_label = 'O' ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20"""
    ),
)
def k06_b_o(spark, sf):
    rows = scored_domains(spark, sf).where("domain_name = 'train_time'")
    return O.confident_errors(rows, O.called("B", "O")).select(
        "source_id", "coarse_probability_max", "coarse_probability_margin", "teff_gspphot"
    )


@query(
    "k06_not_called_ob",
    twin(
        """SELECT source_id, coarse_predicted_label, coarse_probability_max FROM scored_domains WHERE domain_name = 'downstream_pass'
  AND coarse_predicted_label NOT IN ('O', 'B') ORDER BY coarse_probability_max DESC, coarse_probability_margin DESC, 1 LIMIT 20"""
    ),
)
def k06_other(spark, sf):
    rows = scored_domains(spark, sf).where("domain_name = 'downstream_pass'")
    return O.confident_errors(rows, O.not_called("O", "B")).select(
        "source_id", "coarse_predicted_label", "coarse_probability_max"
    )


@query(
    "a49_boundary_classes",
    twin(dist_sql("downstream_ob", "spectral_class", "true_spectral_class")),
)
def a49(spark, sf):
    return distribution(downstream_ob(spark, sf), "spectral_class", "true_spectral_class")


@query(
    "a49_boundary_predictions",
    twin(dist_sql("scored_domains", "coarse_predicted_label", where="domain_name = 'downstream_pass'")),
)
def a49_predictions(spark, sf):
    return distribution(scored_domains(spark, sf).where("domain_name = 'downstream_pass'"), "coarse_predicted_label")


# --- class O --------------------------------------------------------------------------

VIEWS["o_pass"] = """SELECT g.source_id, g.teff_gspphot, c.label AS coarse_predicted_label, c.pmax AS coarse_probability_max
FROM gated g JOIN coarse c USING (source_id) WHERE spectral_class = 'O' AND quality_state = 'pass'"""
VIEWS["o_final"] = """SELECT g.source_id, g.teff_gspphot, d.final_domain_state, d.final_coarse_class, d.final_decision_reason
FROM gated g JOIN decisions d USING (source_id) WHERE g.spectral_class = 'O'"""


def o_rows(spark, sf):
    return R.o_review_rows(B.gated(spark, sf))


def o_scored(spark, sf):
    return summarise_probabilities(R.o_review_rows(B.gated(spark, sf), "pass"), st.CLASS_PROBABILITIES, "coarse")


def o_final(spark, sf):
    run = B.saved_run(spark, sf)
    source = R.o_review_rows(B.gated(spark, sf)).select("source_id", "teff_gspphot")
    return O.final_outcomes(source, run.decisions, run.inputs)


@query("j19_o_outcomes", twin("SELECT * FROM o_final"))
def j19(spark, sf):
    return o_final(spark, sf).select(
        "source_id", "teff_gspphot", "final_domain_state", "final_coarse_class", "final_decision_reason"
    )


@query(
    "j20_prediction_levels",
    twin(
        f"""SELECT coarse_predicted_label, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share, round(avg(coarse_probability_max), 6) AS mean_confidence,
  {q50('coarse_probability_max')} AS median_confidence, max(coarse_probability_max) AS max_confidence FROM o_pass GROUP BY 1"""
    ),
)
def j20(spark, sf):
    return rounded(O.prediction_levels(o_scored(spark, sf)), "mean_confidence", "median_confidence")


@query("a47_o_quality", twin(dist_sql("gated", "quality_state", where="spectral_class = 'O'")))
def a47(spark, sf):
    return distribution(o_rows(spark, sf), "quality_state")


@query("a47_o_outcomes", twin(dist_sql("o_final", "final_decision_reason", top=20)))
def a47_outcomes(spark, sf):
    return distribution(o_final(spark, sf), "final_decision_reason", top_n=20)


@query(
    "a47_hot_membership",
    twin(
        """SELECT 1E4 AS teff_min_k, n AS n_rows_true_o_source, h AS n_rows_hot_subset, h / n AS share_hot_subset_in_source, p AS n_rows_hot_pass,
  p / h AS share_hot_pass_in_hot_subset, p AS n_rows_hot_scored FROM (SELECT count(*) AS n, count(*) FILTER (WHERE teff_gspphot >= 1E4) AS h,
  count(*) FILTER (WHERE teff_gspphot >= 1E4 AND quality_state = 'pass') AS p FROM gated WHERE spectral_class = 'O')"""
    ),
)
def a47_hot(spark, sf):
    return O.hot_membership(o_rows(spark, sf))


@query("a48_hot_outcomes", twin(dist_sql("o_final", "final_domain_state", where="teff_gspphot >= 1E4")))
def a48(spark, sf):
    return distribution(o_final(spark, sf).where("teff_gspphot >= 10000"), "final_domain_state")


@query("a48_hot_quality", twin(dist_sql("gated", "quality_reason", where="spectral_class = 'O' AND teff_gspphot >= 1E4", top=20)))
def a48_quality(spark, sf):
    return distribution(o_rows(spark, sf).where("teff_gspphot >= 10000"), "quality_reason", top_n=20)


# secure O
VIEWS["tail"] = """SELECT p.source_id, l.raw_sptype, p.spectral_subclass, p.spectraltype_esphs, p.flags_esphs, p.in_gold_sample_oba_stars, p.teff_gspphot,
  p.teff_esphs, p.lum_flame, p.radius_gspphot, p.logg_gspphot, p.parallax FROM obpolicy p JOIN labeled l USING (source_id)
WHERE secure AND p.spectral_class = 'O'"""


def tail(spark, sf):
    return O.secure_o_tail(L.ob_policy(ob_rows(spark, sf)), labeled(spark, sf))


@query("j18_secure_o_tail", twin("SELECT source_id, raw_sptype, teff_esphs FROM tail"))
def j18(spark, sf):
    return tail(spark, sf).select("source_id", "raw_sptype", "teff_esphs")


@query(
    "a44_secure_o_summary",
    twin(
        f"""SELECT count(*) AS n_rows, count(spectral_subclass) AS n_with_numeric_subclass, count(teff_esphs) AS n_with_teff_esphs,
  count(*) FILTER (WHERE in_gold_sample_oba_stars) AS n_in_gold_sample_oba, {q50('teff_gspphot')} AS median_teff_gspphot, {q50('teff_esphs')} AS median_teff_esphs,
  {q50('lum_flame')} AS median_lum_flame FROM tail"""
    ),
)
def a44(spark, sf):
    return rounded(
        O.secure_o_summary(tail(spark, sf)), "median_teff_gspphot", "median_teff_esphs", "median_lum_flame"
    )


@query(
    "a44_secure_o_labels",
    twin("SELECT raw_sptype, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share FROM tail GROUP BY 1"),
)
def a44_labels(spark, sf):
    return distribution(tail(spark, sf), "raw_sptype", keep_null=True)


@query(
    "a44_secure_o_esphs",
    twin("SELECT spectraltype_esphs, flags_esphs, teff_esphs IS NOT NULL AS has_teff_esphs, count(*) AS n_rows FROM tail GROUP BY 1, 2, 3"),
)
def a44_esphs(spark, sf):
    return O.secure_o_esphs(tail(spark, sf))


VIEWS["compared"] = """SELECT 'secure_o_tail' AS comparison_group, source_id, teff_gspphot, logg_gspphot, radius_gspphot, parallax FROM obpolicy
WHERE secure AND spectral_class = 'O' UNION ALL SELECT 'reference_o', source_id, teff_gspphot, logg_gspphot, radius_gspphot, parallax FROM stars
WHERE spec_class = 'O' AND NOT is_evolved UNION ALL SELECT 'reference_b', source_id, teff_gspphot, logg_gspphot, radius_gspphot, parallax FROM stars
WHERE spec_class = 'B' AND NOT is_evolved UNION ALL SELECT 'reference_evolved_o', source_id, teff_gspphot, logg_gspphot, radius_gspphot, parallax FROM stars
WHERE spec_class = 'O' AND is_evolved UNION ALL SELECT 'reference_evolved_b', source_id, teff_gspphot, logg_gspphot, radius_gspphot, parallax FROM stars
WHERE spec_class = 'B' AND is_evolved"""


def compared(spark, sf):
    s = st.stars(spark, sf)
    secure = L.ob_policy(ob_rows(spark, sf)).where("ob_policy_bucket = 'secure_o_like' AND spectral_class = 'O'")
    return O.reference_groups(
        secure,
        {
            "reference_o": s.where("spec_class = 'O' AND NOT is_evolved"),
            "reference_b": s.where("spec_class = 'B' AND NOT is_evolved"),
            "reference_evolved_o": s.where("spec_class = 'O' AND is_evolved"),
            "reference_evolved_b": s.where("spec_class = 'B' AND is_evolved"),
        },
    )


@query("u03_reference_groups", twin("SELECT * FROM compared"))
def u03(spark, sf):
    return compared(spark, sf)


_LEVELS = "SELECT comparison_group, " + ", ".join(f"quantile_cont({c}, 5E-1) AS {c}" for c in O.COMPARED) + " FROM compared GROUP BY 1"


@query(
    "a45_reference_distance",
    twin(
        "SELECT r.comparison_group, " + ", ".join(f"round(abs(r.{c} - s.{c}), 6) AS abs_diff_{c}" for c in O.COMPARED)
        + f" FROM ({_LEVELS}) r, ({_LEVELS}) s WHERE s.comparison_group = 'secure_o_tail' AND r.comparison_group <> 'secure_o_tail'"
    ),
)
def a45(spark, sf):
    return rounded(O.reference_distances(compared(spark, sf)), *[f"abs_diff_{c}" for c in O.COMPARED])


VIEWS["splits_full"] = "SELECT * FROM split_rows UNION ALL SELECT * EXCLUDE (split_name), 'full' AS split_name FROM split_rows"


@query(
    "a46_o_split_support",
    twin(
        """SELECT split_name, count(*) AS n_rows_split, count(*) FILTER (WHERE spec_class = 'O') AS n_rows_true_o,
  count(*) FILTER (WHERE spec_class = 'O') / count(*) AS share_true_o_in_split,
  count(*) FILTER (WHERE spec_class = 'O') / (SELECT count(*) FROM split_rows WHERE spec_class = 'O') AS share_true_o_of_total_o FROM splits_full GROUP BY 1"""
    ),
)
def a46(spark, sf):
    return O.o_split_support(coarse_split(spark, sf))


@query(
    "a46_o_teff_bands",
    twin(
        """SELECT split_name, CASE WHEN teff_gspphot < 1E4 THEN '< 10000 K' WHEN teff_gspphot < 15E3 THEN '10000-14999 K' WHEN teff_gspphot < 2E4 THEN '15000-19999 K'
  WHEN teff_gspphot < 25E3 THEN '20000-24999 K' ELSE '>= 25000 K' END AS teff_band, count(*) AS n_rows,
  count(*) / sum(count(*)) OVER (PARTITION BY split_name) AS share_within_split_true_o FROM splits_full WHERE spec_class = 'O' GROUP BY 1, 2"""
    ),
)
def a46_bands(spark, sf):
    return O.o_support_by(coarse_split(spark, sf), O.teff_band(F.col("teff_gspphot")), "teff_band")


@query(
    "a46_hot_ob_support",
    twin(
        """SELECT split_name, spec_class, count(*) AS n_rows, count(*) / sum(count(*)) OVER (PARTITION BY split_name) AS share_within_hot_boundary
  FROM splits_full WHERE spec_class IN ('O', 'B') AND teff_gspphot >= 1E4 GROUP BY 1, 2"""
    ),
)
def a46_hot(spark, sf):
    return O.hot_ob_support(coarse_split(spark, sf))


@query(
    "a46_o_physics",
    twin(
        f"""SELECT split_name, count(*) AS n_rows_true_o, {q50('teff_gspphot')} AS median_teff_gspphot, {q50('logg_gspphot')} AS median_logg_gspphot, {q50('bp_rp')} AS median_bp_rp,
  {q50('coalesce(radius_flame, radius_gspphot)')} AS median_radius_feature, {q50('radius_flame')} AS median_radius_flame FROM splits_full WHERE spec_class = 'O' GROUP BY 1"""
    ),
)
def a46_physics(spark, sf):
    names = [f"median_{c}" for c in ("teff_gspphot", "logg_gspphot", "bp_rp", "radius_feature", "radius_flame")]
    return rounded(O.o_physics(coarse_split(spark, sf)), *names)


@query(
    "k07_hottest_o",
    twin("SELECT source_id, teff_gspphot, split_name FROM split_rows WHERE spec_class = 'O' ORDER BY 2 DESC, 3, 1 LIMIT 20"),
)
def k07(spark, sf):
    return O.hottest_o(coarse_split(spark, sf)).select("source_id", "teff_gspphot", "split_name")
