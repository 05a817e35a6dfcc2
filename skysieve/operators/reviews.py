"""Reviews of a decision run, of gate and priority variants, of hosts and scoring runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.labels import normalize_stage
from skysieve.functions.numeric import to_number
from skysieve.functions.policy import gate_reason
from skysieve.functions.scores import priority_label
from skysieve.operators.distributions import (
    as_label,
    count_flags,
    crosstab,
    distribution,
    to_metric_rows,
    with_share,
)
from skysieve.operators.ordered import (
    exact_quantiles,
    grouped_summary,
    medians,
    null_safe_join,
)
from skysieve.operators.ranking import ranking_order
from skysieve.operators.skew import by_shuffle

# --- fixed values: column lists and category orders -------------------------------------

QUALITY_STATES = ("pass", "unknown", "reject")
DOMAIN_STATES = ("id", "candidate_ood", "ood", "unknown")
LABEL_VARIANTS = (
    C.LabelVariant("baseline", 0.75, 0.45),
    C.LabelVariant("strict_high_080", 0.80, 0.45),
    C.LabelVariant("strict_high_medium_085_055", 0.85, 0.55),
)
QUANTILES = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
PRIORITY_COMPONENTS = (
    "priority_score",
    "host_similarity_score",
    "observability_score",
    "class_priority_score",
    "brightness_score",
    "distance_score",
    "astrometry_score",
)
COHORT_PHYSICS = (
    "teff_gspphot",
    "logg_gspphot",
    "mh_gspphot",
    "parallax",
    "parallax_over_error",
    "ruwe",
    "phot_g_mean_mag",
    "radius_flame",
    "lum_flame",
)
STATE_METRICS = ("host_similarity_score", "parallax", "parallax_over_error", "ruwe", "phot_g_mean_mag")
STAR_RESULT_COLUMNS = (
    "source_id",
    "hostname",
    "ra",
    "dec",
    "final_domain_state",
    "final_quality_state",
    "final_coarse_class",
    "final_coarse_confidence",
    "final_refinement_label",
    "final_refinement_state",
    "final_refinement_confidence",
    "final_decision_reason",
    "quality_reason",
    "review_bucket",
    "priority_score",
    "priority_label",
    "priority_reason",
    "host_similarity_score",
    "teff_gspphot",
    "logg_gspphot",
    "mh_gspphot",
    "parallax",
    "parallax_over_error",
    "ruwe",
    "phot_g_mean_mag",
    "radius_flame",
    "radius_gspphot",
    "lum_flame",
    "evolstage_flame",
)
SUMMARY_COLUMNS = (
    "source_id",
    "final_domain_state",
    "final_quality_state",
    "final_coarse_class",
    "final_refinement_label",
    "final_refinement_state",
    "final_decision_reason",
    "quality_reason",
    "review_bucket",
    "priority_label",
    "priority_score",
    "priority_reason",
    "host_similarity_score",
    "observability_score",
)
PHYSICS_COLUMNS = (
    "source_id",
    "spec_class",
    "spec_subclass",
    "evolution_stage",
    "teff_gspphot",
    "logg_gspphot",
    "mh_gspphot",
    "bp_rp",
    "parallax",
    "parallax_over_error",
    "ruwe",
    "phot_g_mean_mag",
    "radius_flame",
    "lum_flame",
    "evolstage_flame",
)
TOP_SCORING_COLUMNS = (
    "source_id",
    "spec_class",
    "evolution_stage",
    "priority_score",
    "priority_label",
    "host_similarity_score",
    "observability_score",
    "observability_evidence_count",
    "priority_reason",
)


def text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("source_id", F.col("source_id").cast("string"))


def add_new(left: DataFrame, right: DataFrame, names=None) -> DataFrame:
    """Left join on the id (as text) of the columns that `left` does not have yet."""
    have = set(left.columns)
    wanted = [c for c in (names or right.columns) if c in right.columns and c not in have]
    if not wanted:
        return left
    return text_id(left).join(by_shuffle(text_id(right).select("source_id", *wanted)), "source_id", "left")


# --- decision run ---------------------------------------------------------------------


def domain_quality_crosstab(decisions: DataFrame) -> DataFrame:
    return crosstab(decisions, "final_domain_state", "final_quality_state", QUALITY_STATES)


def run_summary(decisions: DataFrame, ranking: DataFrame) -> DataFrame:
    """Row counts per domain state and label in one row."""
    state, label = F.col("final_domain_state"), F.col("priority_label")
    base = decisions.agg(
        F.count("*").alias("total_objects"),
        F.countDistinct("source_id").alias("n_unique_source_id"),
        *count_flags({"id_count": state == "id", "unknown_count": state == "unknown", "ood_count": state == "ood"}),
    )
    ranked = ranking.agg(
        *count_flags(
            {
                "ranked_count": label.isin("high", "medium", "low"),
                "high_priority_count": label == "high",
                "medium_priority_count": label == "medium",
                "low_priority_count": label == "low",
            }
        )
    )
    out = base.withColumns({c: ranked.select(c).scalar() for c in ranked.columns})
    share = F.when(F.col("ranked_count") > 0, F.col("high_priority_count") / F.col("ranked_count"))
    return out.withColumn("high_priority_share", F.coalesce(share, F.lit(0.0)))


def host_signal_status(inputs: DataFrame, priority_input: DataFrame, ranking: DataFrame) -> DataFrame:
    """Whether a host signal was there and reached the ranking."""
    signal = any(
        "host_similarity_score" in df.columns for df in (inputs, priority_input, ranking)
    )
    counts = priority_input.agg(F.count("*").alias("priority_input_rows")).withColumn(
        "priority_output_rows", ranking.agg(F.count("*")).scalar()
    )
    note = F.when(F.lit(signal) & (F.col("priority_output_rows") > 0), "host_signal_ranked").when(
        F.lit(signal), "host_signal_without_ranking"
    )
    return counts.withColumns(
        {"host_signal_available": F.lit(signal), "status_note": note.otherwise("host_signal_absent")}
    )


def state_metrics(inputs: DataFrame, decisions: DataFrame, group: str = "final_domain_state") -> DataFrame:
    """Mean, median and count of each metric per state, in long form."""
    have = [c for c in STATE_METRICS if c in inputs.columns]
    rows = inputs.select("source_id", *have).join(by_shuffle(decisions.select("source_id", group)), "source_id")
    means = rows.groupBy(group).agg(*[F.avg(c).alias(c) for c in have]).unpivot(
        [group], have, "metric_name", "mean_value"
    )
    med = exact_quantiles(rows, [group], have, [0.5]).withColumnsRenamed(
        {"q0": "median_value", "n_values": "n_rows"}
    )
    return null_safe_join(med, means, [group, "metric_name"]).withColumnRenamed(group, "group_value")


def component_quantiles(ranking: DataFrame, components=PRIORITY_COMPONENTS, quantiles=QUANTILES) -> DataFrame:
    """Quantiles as rows, score components as columns."""
    have = [c for c in components if c in ranking.columns]
    long = exact_quantiles(ranking, [], have, quantiles)
    rows = long.select(
        "metric_name",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("v"))
                    for i, q in enumerate(quantiles)
                ]
            )
        ).alias("s"),
    )
    return rows.groupBy(F.col("s.quantile").alias("quantile")).agg(
        *[F.max(F.when(F.col("metric_name") == c, F.col("s.v"))).alias(c) for c in have]
    )


def score_by_class(ranking: DataFrame, decisions: DataFrame) -> DataFrame:
    """Level of the priority score per coarse class."""
    rows = text_id(ranking.select("source_id", "priority_score")).join(
        by_shuffle(text_id(decisions.select("source_id", "final_coarse_class"))), "source_id", "left"
    )
    s = F.col("priority_score")
    return grouped_summary(
        rows.where(s.isNotNull()),
        ["final_coarse_class"],
        [
            F.count("*").alias("n_rows"),
            F.avg(s).alias("mean_priority_score"),
            F.max(s).alias("max_priority_score"),
            F.min(s).alias("min_priority_score"),
        ],
        {"median_priority_score": "priority_score"},
    )


def top_priority(ranking: DataFrame, decisions: DataFrame, top_n: int = 20) -> DataFrame:
    """Best ranked rows with their decision: the top is cut first, then joined."""
    top = ranking.orderBy(*ranking_order()).limit(top_n)
    final = text_id(decisions).select(
        "source_id", "final_domain_state", "final_quality_state", "final_coarse_class", "final_refinement_label"
    )
    return top.join(final, "source_id", "left").select(
        "source_id",
        "final_domain_state",
        "final_quality_state",
        "final_coarse_class",
        "final_refinement_label",
        "priority_score",
        "priority_label",
        "priority_reason",
    )


def high_cohort(ranking: DataFrame, decisions: DataFrame, inputs: DataFrame) -> DataFrame:
    """High-priority rows with decision and physics; the filter runs before the joins."""
    high = text_id(ranking).where(F.col("priority_label") == "high")
    final = text_id(decisions).select(
        "source_id",
        "final_domain_state",
        "final_quality_state",
        "final_coarse_class",
        "final_refinement_label",
        "final_decision_reason",
    )
    physics = text_id(inputs).select("source_id", *[c for c in COHORT_PHYSICS if c in inputs.columns])
    return high.join(by_shuffle(final), "source_id", "left").join(by_shuffle(physics), "source_id", "left")


def cohort_summary(cohort: DataFrame, ranking: DataFrame, decisions: DataFrame) -> DataFrame:
    named = {
        f"median_{c}": c
        for c in (
            "priority_score",
            "host_similarity_score",
            "observability_score",
            "parallax_over_error",
            "ruwe",
            "phot_g_mean_mag",
        )
    }
    med = medians(cohort, [], named)
    n_ranked = ranking.agg(F.count("*")).scalar()
    n_id = decisions.agg(F.count_if(F.col("final_domain_state") == "id")).scalar()
    base = cohort.agg(F.count("*").alias("n_rows")).withColumns(
        {
            "share_priority_ranking": F.col("n_rows") / F.greatest(n_ranked, F.lit(1)),
            "share_final_id": F.col("n_rows") / F.greatest(n_id, F.lit(1)),
        }
    )
    return null_safe_join(base, med, [])  # one row each


def cohort_components(cohort: DataFrame) -> DataFrame:
    """Quartiles of scores and physics inside the high cohort."""
    have = [c for c in (*PRIORITY_COMPONENTS, *COHORT_PHYSICS) if c in cohort.columns]
    return exact_quantiles(cohort, [], have, [0.25, 0.5, 0.75]).select(
        "metric_name",
        F.col("q0").alias("p25_value"),
        F.col("q1").alias("median_value"),
        F.col("q2").alias("p75_value"),
    )


def cohort_preview(cohort: DataFrame, top_n: int = 10) -> DataFrame:
    names = (
        "source_id", "final_coarse_class", "final_refinement_label", "priority_score", "priority_reason",
        *PRIORITY_COMPONENTS[1:], *COHORT_PHYSICS,
    )
    order = [
        F.desc_nulls_last(c)
        for c in ("priority_score", "host_similarity_score", "observability_score", "parallax_over_error")
    ]
    have = set(cohort.columns)
    return cohort.orderBy(*order, "source_id").select(*[c for c in names if c in have]).limit(top_n)


def star_results(inputs: DataFrame, decisions: DataFrame, ranking: DataFrame) -> DataFrame:
    """One wide row per star; columns nobody supplies are NULL."""
    merged = text_id(inputs).join(
        by_shuffle(text_id(decisions).select("source_id", *[c for c in decisions.columns if c not in inputs.columns])),
        "source_id",
    )
    extra = [c for c in STAR_RESULT_COLUMNS if c in ranking.columns and c not in merged.columns]
    merged = merged.join(by_shuffle(text_id(ranking).select("source_id", *extra)), "source_id", "left")
    have = set(merged.columns)
    return merged.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in STAR_RESULT_COLUMNS]
    )


def star_preview(results: DataFrame, state: str | None = None, top_n: int = 20) -> DataFrame:
    """Best stars of the in-domain part, or rejected ones grouped by reason."""
    rows = results if state is None else results.where(F.col("final_domain_state") == state)
    if state == "id":
        order = [
            F.desc_nulls_last(c)
            for c in (
                "priority_score",
                "final_refinement_confidence",
                "final_coarse_confidence",
                "parallax_over_error",
            )
        ]
    else:
        order = [
            *[F.asc_nulls_last(c) for c in ("final_decision_reason", "review_bucket", "quality_reason")],
            F.desc_nulls_last("parallax_over_error"),
        ]
    return rows.orderBy(*order, "source_id").limit(top_n)


def run_browser(decisions: DataFrame, ranking: DataFrame, priority_input: DataFrame, inputs: DataFrame) -> DataFrame:
    """Decision rows with the ranking and label columns they do not carry yet."""
    out = decisions
    for df, names in (
        (ranking, ("priority_label", "priority_score", "priority_reason", "host_similarity_score", "observability_score")),
        (priority_input, ("host_similarity_score", "observability_score")),
        (inputs, ("spec_class", "spec_subclass", "quality_reason", "review_bucket")),
    ):
        out = add_new(out, df, names)
    return out


def browser_order():
    return [
        *[F.desc_nulls_last(c) for c in ("priority_score", "host_similarity_score", "observability_score")],
        "source_id",
    ]


@dataclass(frozen=True)
class BrowserFilter:
    domain_states: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    id_text: str | None = None


def filter_browser(browser: DataFrame, wanted: BrowserFilter) -> DataFrame:
    """Keep rows of the chosen states, labels and classes whose id contains the text."""
    out = browser
    for column, values in (
        ("final_domain_state", wanted.domain_states),
        ("priority_label", wanted.labels),
        ("spec_class", wanted.classes),
    ):
        if values:
            out = out.where(F.col(column).isin(*values))
    text = (wanted.id_text or "").strip()
    return out.where(F.col("source_id").cast("string").contains(text)) if text else out


def filter_options(browser: DataFrame) -> DataFrame:
    """Distinct non-blank values per filter column with their display position."""
    preferred = {
        "final_domain_state": ("id", "unknown", "ood"),
        "priority_label": ("high", "medium", "low"),
        "spec_class": (),
    }
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("label"))
                for c in preferred
                if c in browser.columns
            ]
        )
    ).alias("s")
    values = browser.select(cells).select("s.*").where(F.trim("label") != "").distinct()
    position = F.lit(None).cast("int")
    for column, order in preferred.items():
        for i, label in enumerate(order):
            position = F.when(
                (F.col("column_name") == column) & (F.col("label") == label), F.lit(i)
            ).otherwise(position)
    return values.withColumn("preferred_position", position).orderBy(
        "column_name", F.asc_nulls_last("preferred_position"), "label"
    )


def lookup(source_id, decisions: DataFrame, *others: DataFrame) -> DataFrame:
    """One star across the tables of a run: every side is filtered before it is joined."""
    key = str(source_id)

    def one(df):
        return text_id(df.where(F.col("source_id").cast("string") == key))

    out = one(decisions)
    for df in others:
        out = add_new(out, one(df))
    return out


def pad(df: DataFrame, names) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in names])


def route_rows(summary: DataFrame) -> DataFrame:
    """Four stage rows per object: gate, refinement, routing, ranking."""
    stages = (
        ("quality_gate", "final_quality_state", "quality_reason"),
        ("class_refinement", "final_refinement_state", "final_refinement_label"),
        ("final_routing", "final_domain_state", "final_decision_reason"),
        ("priority_ranking", "priority_label", "priority_reason"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("stage_name"),
                F.nullif(F.trim(state), F.lit("")).alias("stage_state"),
                F.nullif(F.trim(reason), F.lit("")).alias("stage_reason"),
            )
            for name, state, reason in stages
        ]
    )
    return summary.select("source_id", F.explode(cells).alias("s")).select("source_id", "s.*")


# --- gate -----------------------------------------------------------------------------


def gate_summary(gated: DataFrame) -> DataFrame:
    q, o = F.col("quality_state"), F.col("ood_state")
    return gated.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("source_id").alias("n_unique_source_id"),
        *count_flags(
            {
                "n_pass_rows": q == "pass",
                "n_unknown_rows": q == "unknown",
                "n_reject_rows": q == "reject",
                "n_in_domain_rows": o == "in_domain",
                "n_candidate_ood_rows": o == "candidate_ood",
                "n_ood_rows": o == "ood",
            }
        ),
    )


def gate_signals(gated: DataFrame) -> DataFrame:
    """Per flag: how often it is set, and over which states (A12). One aggregate over all flags."""
    flags = [c for c in C.GATE_SIGNAL_COLUMNS if c in gated.columns]
    cells = gated.groupBy("quality_state", "ood_state").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in flags]
    )
    long = cells.unpivot(["quality_state", "ood_state", "n"], flags, "signal_name", "hits")

    def total(column, value):
        return F.coalesce(F.sum(F.when(F.col(column) == value, F.col("hits"))), F.lit(0))

    return long.groupBy("signal_name").agg(
        F.sum("hits").alias("n_rows_true"),
        (F.sum("hits") / F.sum("n")).alias("share_true"),
        total("quality_state", "pass").alias("n_pass_true"),
        total("quality_state", "unknown").alias("n_unknown_true"),
        total("quality_state", "reject").alias("n_reject_true"),
        total("ood_state", "in_domain").alias("n_in_domain_true"),
        total("ood_state", "candidate_ood").alias("n_candidate_ood_true"),
        total("ood_state", "ood").alias("n_ood_true"),
    )


def with_gate_variants(gated: DataFrame, variants=C.GATE_VARIANTS) -> DataFrame:
    """Every row once per policy with the reason that policy gives; one pass for all variants."""
    no_flame = (
        F.coalesce("has_missing_flame_features", F.lit(False))
        if "has_missing_flame_features" in gated.columns
        else F.col("radius_flame").isNull()
    )
    rejected = F.col("quality_state") == "reject"
    cells = []
    for v in variants:
        why = gate_reason(to_number(F.col("ruwe")), to_number(F.col("parallax_over_error")), no_flame, v)
        cells.append(
            F.struct(
                F.lit(v.name).alias("policy_name"),
                F.when(rejected, F.col("quality_reason")).otherwise(why).alias("variant_quality_reason"),
            )
        )
    out = gated.withColumn("_v", F.explode(F.array(*cells))).select("*", "_v.*").drop("_v")
    state = F.when(rejected, "reject").when(F.col("variant_quality_reason") == "pass", "pass")
    return out.withColumn("variant_quality_state", state.otherwise("unknown"))


def gate_variant_summary(gated: DataFrame, variants=C.GATE_VARIANTS) -> DataFrame:
    state = F.col("variant_quality_state")
    counts = with_gate_variants(gated, variants).groupBy("policy_name").agg(
        F.count("*").alias("n_rows"),
        *count_flags(
            {"n_pass_rows": state == "pass", "n_unknown_rows": state == "unknown", "n_reject_rows": state == "reject"}
        ),
    )
    policies = gated.sparkSession.createDataFrame(
        [(v.name, v.max_ruwe, v.min_parallax_snr, v.require_flame) for v in variants],
        "policy_name string, ruwe_unknown_threshold double, parallax_snr_unknown_threshold double, require_flame_for_pass boolean",
    )
    return policies.join(counts, "policy_name").withColumns(
        {f"share_{s}": F.col(f"n_{s}_rows") / F.col("n_rows") for s in QUALITY_STATES}
    )


def gate_variant_transitions(gated: DataFrame, variant: C.GatePolicy) -> DataFrame:
    rows = with_gate_variants(gated, (variant,))
    return crosstab(rows, "quality_state", "variant_quality_state", QUALITY_STATES)


def gate_variant_reasons(gated: DataFrame, variant: C.GatePolicy, top_n: int = 20) -> DataFrame:
    return distribution(with_gate_variants(gated, (variant,)), "variant_quality_reason", top_n=top_n)


def gate_variant_changes(gated: DataFrame, variant: C.GatePolicy, top_n: int = 50) -> DataFrame:
    names = (
        "source_id", "quality_state", "variant_quality_state", "quality_reason", "variant_quality_reason",
        "review_bucket", "ruwe", "parallax_over_error", "radius_flame", "non_single_star",
        "classprob_dsc_combmod_star", "spectral_class", "spectral_subclass",
    )
    rows = with_gate_variants(gated, (variant,))
    changed = rows.where(F.col("quality_state") != F.col("variant_quality_state"))
    return changed.select(*[c for c in names if c in rows.columns]).orderBy("source_id").limit(top_n)


# --- priority thresholds --------------------------------------------------------------


def variant_labels(ranking: DataFrame, variants=LABEL_VARIANTS) -> DataFrame:
    score = to_number(F.col("priority_score"))
    cells = F.array(
        *[
            F.struct(
                F.lit(v.name).alias("variant_name"),
                F.lit(float(v.high)).alias("high_min"),
                F.lit(float(v.medium)).alias("medium_min"),
                F.when(score.isNotNull(), priority_label(score, v.high, v.medium)).alias("variant_label"),
            )
            for v in variants
        ]
    )
    return ranking.withColumn("_v", F.explode(cells)).select("*", "_v.*").drop("_v")


def _label_counts(label: Column) -> list[Column]:
    return count_flags({f"n_{x}": label == x for x in ("high", "medium", "low")})


def _label_shares(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f"share_{x}": F.coalesce(F.when(F.col("n_rows") > 0, F.col(f"n_{x}") / F.col("n_rows")), F.lit(0.0))
            for x in ("high", "medium", "low")
        }
    )


def label_variant_summary(ranking: DataFrame, variants=LABEL_VARIANTS) -> DataFrame:
    """Counts and shares of labels under each pair of cuts, one pass."""
    label = F.col("variant_label")
    counts = variant_labels(ranking, variants).groupBy("variant_name", "high_min", "medium_min").agg(
        F.count(label).alias("n_rows"),
        *_label_counts(label),
        F.count_if(F.col("priority_label") != label).alias("n_changed_from_baseline"),
    )
    return _label_shares(counts).withColumn(
        "share_changed_from_baseline",
        F.coalesce(F.when(F.col("n_rows") > 0, F.col("n_changed_from_baseline") / F.col("n_rows")), F.lit(0.0)),
    )


def label_transitions(ranking: DataFrame, variant: C.LabelVariant) -> DataFrame:
    counts = variant_labels(ranking, (variant,)).groupBy(
        F.col("priority_label").alias("baseline_label"), "variant_label"
    ).agg(F.count("*").alias("n_rows"))
    return with_share(counts)


def label_variant_by_class(ranking: DataFrame, variant: C.LabelVariant, column: str = "final_coarse_class") -> DataFrame:
    counts = variant_labels(ranking, (variant,)).groupBy(as_label(F.col(column)).alias(column)).agg(
        F.count("*").alias("n_rows"), *_label_counts(F.col("variant_label"))
    )
    return _label_shares(counts)


# --- hosts ----------------------------------------------------------------------------


def host_contract_summary(df: DataFrame) -> DataFrame:
    have = [c for c in C.HOST_CORE_FEATURES if c in df.columns]
    ready = F.lit(len(have) == len(C.HOST_CORE_FEATURES))
    for c in have:
        ready = ready & F.col(c).isNotNull()
    radius = F.col("radius_flame").isNotNull() if "radius_flame" in df.columns else F.lit(False)
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("source_id").alias("n_unique_source_id"),
        F.countDistinct("spec_class").alias("n_supported_classes"),
        F.countDistinct("evolution_stage").alias("n_supported_stages"),
        F.count_if(radius).alias("n_rows_with_canonical_radius"),
        F.count_if(ready).alias("n_rows_clean_core_ready"),
    )
    return counts.withColumns(
        {
            "n_core_features": F.lit(len(C.HOST_CORE_FEATURES)),
            "n_core_features_present": F.lit(len(have)),
            "has_canonical_radius_column": F.lit("radius_flame" in df.columns),
            "share_rows_with_canonical_radius": F.col("n_rows_with_canonical_radius") / F.col("n_rows"),
            "share_rows_clean_core_ready": F.col("n_rows_clean_core_ready") / F.col("n_rows"),
        }
    )


def column_coverage(df: DataFrame, names) -> DataFrame:
    """feature_name, n_non_missing, share_non_missing from one aggregate over all columns."""
    names = list(names)
    have = set(df.columns)
    wide = df.agg(
        F.count("*").alias("_n"),
        *[(F.count(c) if c in have else F.lit(0).cast("long")).alias(c) for c in names],
    )
    long = wide.unpivot(["_n"], names, "feature_name", "n_non_missing")
    share = F.coalesce(F.when(F.col("_n") > 0, F.col("n_non_missing") / F.col("_n")), F.lit(0.0))
    return long.withColumn("share_non_missing", share)


def feature_coverage(df: DataFrame) -> DataFrame:
    name = F.col("feature_name")
    group = (
        F.when(name.isin(*C.HOST_CORE_FEATURES), "core")
        .when(name.isin(*C.HOST_OBSERVABILITY_FEATURES), "observability")
        .when(name.isin(*C.HOST_CONTEXT_FEATURES), "context")
        .otherwise("optional_physical")
    )
    return column_coverage(df, C.HOST_ALL_FEATURES).drop("_n").withColumns(
        {
            "feature_group": group,
            "is_required": name.isin(*C.HOST_CORE_FEATURES),
            "column_present": name.isin(*[c for c in C.HOST_ALL_FEATURES if c in df.columns]),
        }
    )


def missing_core(df: DataFrame) -> DataFrame:
    have = [c for c in C.HOST_CORE_FEATURES if c in df.columns]
    return column_coverage(df, C.HOST_CORE_FEATURES).select(
        "feature_name",
        (F.col("_n") - F.col("n_non_missing")).alias("n_missing_rows"),
        (1.0 - F.col("share_non_missing")).alias("share_missing_rows"),
        F.col("feature_name").isin(*have).alias("column_present"),
    )


def host_training_summary(df: DataFrame) -> DataFrame:
    have = set(df.columns)

    def distinct(c):
        return F.countDistinct(c) if c in have else F.lit(0).cast("long")

    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("source_id").alias("n_unique_source_id"),
        distinct("hostname").alias("n_unique_hostname"),
        (F.count("spec_subclass") if "spec_subclass" in have else F.lit(0).cast("long")).alias("n_spec_subclass_rows"),
        distinct("spec_class").alias("n_supported_classes"),
        distinct("evolution_stage").alias("n_supported_stages"),
    )


def subclass_coverage(df: DataFrame) -> DataFrame:
    """Rows with a subclass per class."""
    return df.groupBy("spec_class").agg(
        F.count("*").alias("n_rows"),
        F.count("spec_subclass").alias("n_with_subclass"),
        (F.count("spec_subclass") / F.count("*")).alias("share_with_subclass"),
        F.countDistinct("spec_subclass").alias("n_subclasses"),
    )


# --- scoring runs ---------------------------------------------------------------------


def observability_coverage(ranking: DataFrame) -> DataFrame:
    flags = ("brightness_available", "distance_available", "astrometry_available")
    means = ranking.agg(
        *[F.avg(F.col(c).cast("int")).alias(c) for c in flags],
        F.avg("observability_evidence_count").alias("mean_observability_evidence_count"),
    )
    return to_metric_rows(means)


def goal_alignment(ranking: DataFrame, top_n: int = 20) -> DataFrame:
    """What the first rows of a ranking look like: class, stage and label shares, mean scores."""
    top = ranking.orderBy(*ranking_order()).limit(top_n)
    letter, stage = F.upper("spec_class"), normalize_stage(F.col("evolution_stage"))
    label = F.col("priority_label")

    def share(test):
        return F.avg(F.coalesce(test, F.lit(False)).cast("int"))

    return to_metric_rows(
        top.agg(
            F.count("*").alias("top_n"),
            share(letter.isin(*C.TARGET_CLASSES)).alias("target_class_share"),
            share(letter.isin(*C.LOW_PRIORITY_CLASSES)).alias("low_priority_class_share"),
            share(stage == "dwarf").alias("dwarf_share"),
            share(stage == "evolved").alias("evolved_share"),
            share(label == "high").alias("high_priority_share"),
            share(label == "medium").alias("medium_priority_share"),
            share(label == "low").alias("low_priority_share"),
            *[
                F.avg(c).alias(f"mean_{c}")
                for c in (
                    "host_similarity_score",
                    "observability_score",
                    "observability_evidence_count",
                    "priority_score",
                )
            ],
        )
    )


# --- benchmarks -----------------------------------------------------------------------


def best_rows(metrics: DataFrame, cv: DataFrame) -> DataFrame:
    """Best test model and best cross-validated model per run."""
    test = metrics.where(F.col("split_name") == "test").groupBy("run_id").agg(
        F.max_by(
            F.struct("model_name", "accuracy", "balanced_accuracy", "macro_f1"),
            F.struct("accuracy", "macro_f1", "balanced_accuracy"),
        ).alias("t")
    )
    folds = cv.groupBy("run_id").agg(
        F.max_by(
            F.struct("model_name", "mean_accuracy", "mean_balanced_accuracy", "mean_macro_f1"),
            F.struct("mean_macro_f1", "mean_accuracy", "mean_balanced_accuracy"),
        ).alias("c")
    )
    return test.join(folds, "run_id", "full").select(
        "run_id",
        F.col("t.model_name").alias("best_test_model"),
        F.col("t.accuracy").alias("test_accuracy"),
        F.col("t.balanced_accuracy").alias("test_balanced_accuracy"),
        F.col("t.macro_f1").alias("test_macro_f1"),
        F.col("c.model_name").alias("best_cv_model"),
        F.col("c.mean_accuracy").alias("cv_mean_accuracy"),
        F.col("c.mean_balanced_accuracy").alias("cv_mean_balanced_accuracy"),
        F.col("c.mean_macro_f1").alias("cv_mean_macro_f1"),
    )


def metrics_long(best: DataFrame, key: str = "run_id") -> DataFrame:
    """Stage metrics as rows for side-by-side reading."""
    names = [c for c in best.columns if c.startswith(("test_", "cv_mean_"))]
    return best.unpivot([key], names, "metric_name", "metric_value").where(F.col("metric_value").isNotNull())
