"""Reviews of the hot O/B boundary: domain shift, secure O stars, support of class O."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators.distributions import as_label, with_share
from skysieve.operators.evaluation import separability
from skysieve.operators.ordered import grouped_summary, medians, null_safe_join
from skysieve.operators.skew import by_shuffle

PHYSICS = (*C.CORE_FEATURES, "radius_feature", "radius_flame")
# fixed values: edges of the temperature bands
TEFF_BANDS_K = (10_000, 15_000, 20_000, 25_000)


def scoring_frame(df: DataFrame) -> DataFrame:
    """Class from spec_class and radius_feature from FLAME, else GSP-Phot, by presence."""
    have = set(df.columns)
    out = df
    if "spectral_class" not in have and "spec_class" in have:
        out = out.withColumn("spectral_class", F.upper("spec_class"))
    if "radius_feature" not in have:
        source = next((c for c in ("radius_flame", "radius_gspphot") if c in have), None)
        if source:
            out = out.withColumn("radius_feature", F.col(source))
    return out


def train_boundary(df: DataFrame, min_teff: float = C.HOT_TEFF_K) -> DataFrame:
    letter = F.upper("spec_class")
    hot = df.where(letter.isin("O", "B") & (F.col("teff_gspphot") >= min_teff))
    return hot.withColumns({"spectral_class": letter, "domain_name": F.lit("train_time")})


def downstream_boundary(df: DataFrame) -> DataFrame:
    return scoring_frame(df.withColumn("spectral_class", F.upper("spectral_class"))).withColumn(
        "domain_name", F.lit("downstream_pass")
    )


def both_domains(train: DataFrame, downstream: DataFrame) -> DataFrame:
    """Train-time and downstream rows in one frame; absent columns become NULL."""
    return train.unionByName(downstream, allowMissingColumns=True)


def confusion_shares(df: DataFrame, groups=("domain_name",)) -> DataFrame:
    """Counts of true against predicted class with the share inside the true class."""
    groups = list(groups)
    counts = df.groupBy(
        *groups,
        as_label(F.col("spectral_class")).alias("true_spectral_class"),
        as_label(F.col("coarse_predicted_label")).alias("coarse_predicted_label"),
    ).agg(F.count("*").alias("n_rows"))
    return with_share(counts, name="share_within_true_class", within=[*groups, "true_spectral_class"])


def probability_summary(df: DataFrame, groups=("domain_name",)) -> DataFrame:
    """Level of P(O) and P(B) by true class."""
    keyed = df.withColumn("true_spectral_class", F.col("spectral_class"))
    return grouped_summary(
        keyed,
        [*groups, "true_spectral_class"],
        [
            F.count("*").alias("n_rows"),
            F.avg("coarse_probability__O").alias("mean_probability__O"),
            F.avg("coarse_probability__B").alias("mean_probability__B"),
        ],
        {
            "median_probability__O": "coarse_probability__O",
            "median_probability__B": "coarse_probability__B",
        },
    )


def physics_summary(df: DataFrame, groups, features=PHYSICS) -> DataFrame:
    """Medians of the physics columns per group."""
    have = set(df.columns)
    named = {f"median_{f}": f for f in features if f in have}
    return grouped_summary(df, groups, [F.count("*").alias("n_rows")], named)


def missing_shares(df: DataFrame, groups, features=C.COARSE_FEATURES) -> DataFrame:
    """Share of missing cells per group and feature (A43): one aggregate, then turned to rows."""
    have = [f for f in features if f in df.columns]
    groups = list(groups)
    wide = df.groupBy(*groups).agg(
        F.count("*").alias("n_rows"),
        *[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in have],
    )
    return wide.unpivot([*groups, "n_rows"], have, "feature_name", "missing_share")


def missing_gap(df: DataFrame, features=C.COARSE_FEATURES) -> DataFrame:
    """Missing share of both domains side by side and their difference."""
    shares = missing_shares(df, ["domain_name", "spectral_class"], features)
    wide = shares.groupBy("spectral_class", "feature_name").agg(
        *[
            F.max(F.when(F.col("domain_name") == d, F.col("missing_share"))).alias(d)
            for d in ("train_time", "downstream_pass")
        ]
    )
    return wide.withColumn("missing_gap", F.col("downstream_pass") - F.col("train_time"))


def domain_shift_auc(df: DataFrame, features=C.COARSE_FEATURES) -> DataFrame:
    out = separability(
        df.withColumn("true_spectral_class", F.col("spectral_class")),
        ["true_spectral_class"],
        features,
        "domain_name",
        "downstream_pass",
        "train_time",
    )
    return out.withColumnsRenamed(
        {
            "auc": "auc_ovr_downstream",
            "higher_side": "higher_value_domain",
            "median_high": "median_downstream_pass",
            "median_low": "median_train_time",
        }
    )


def class_separability_auc(df: DataFrame, features=C.COARSE_FEATURES) -> DataFrame:
    letter = df.withColumn("spec_class", F.upper("spec_class"))
    out = separability(letter, [], features, "spec_class", "O", "B")
    return out.withColumnsRenamed(
        {
            "auc": "auc_ovr_o",
            "higher_side": "higher_value_class",
            "median_high": "median_o",
            "median_low": "median_b",
        }
    ).withColumn("median_gap", F.col("median_o") - F.col("median_b"))


PREVIEW_COLUMNS = (
    "source_id",
    "spectral_class",
    "coarse_predicted_label",
    "coarse_probability__O",
    "coarse_probability__B",
    "coarse_probability_max",
    "coarse_probability_margin",
    *C.CORE_FEATURES,
    "radius_flame",
)


def confident_errors(df: DataFrame, wrong: Column, top_n: int = 20) -> DataFrame:
    """Most confident rows among those where `wrong` holds; the id breaks ties."""
    have = set(df.columns)
    return (
        df.where(wrong)
        .select(*[c for c in PREVIEW_COLUMNS if c in have])
        .orderBy(F.desc("coarse_probability_max"), F.desc("coarse_probability_margin"), "source_id")
        .limit(top_n)
    )


def called(true_class: str, predicted: str) -> Column:
    return (F.upper("spectral_class") == true_class) & (F.upper("coarse_predicted_label") == predicted)


def not_called(*classes: str) -> Column:
    return ~F.coalesce(F.upper("coarse_predicted_label").isin(*classes), F.lit(False))


def prediction_levels(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Predicted labels with their share and confidence levels."""
    labelled = df.withColumn("coarse_predicted_label", as_label(F.col("coarse_predicted_label")))
    counts = grouped_summary(
        labelled,
        ["coarse_predicted_label"],
        [
            F.count("*").alias("n_rows"),
            F.avg("coarse_probability_max").alias("mean_confidence"),
            F.max("coarse_probability_max").alias("max_confidence"),
        ],
        {"median_confidence": "coarse_probability_max"},
    )
    return with_share(counts).orderBy(F.desc("n_rows"), "coarse_predicted_label").limit(top_n)


def final_outcomes(source: DataFrame, decisions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Fate of the given rows in a decision run."""
    final = decisions.select(
        "source_id",
        "final_domain_state",
        "final_quality_state",
        "final_coarse_class",
        "final_coarse_confidence",
        "final_refinement_label",
        "final_refinement_state",
        "final_refinement_confidence",
        "final_decision_reason",
    )
    reasons = inputs.select("source_id", "quality_reason", "review_bucket", "ood_state", "ood_reason")
    return source.join(by_shuffle(final), "source_id", "left").join(by_shuffle(reasons), "source_id", "left")


def hot_membership(o_rows: DataFrame, min_teff: float = C.HOT_TEFF_K) -> DataFrame:
    """How many class O rows are hot, and how many of those passed."""
    hot = F.coalesce(F.col("teff_gspphot") >= min_teff, F.lit(False))
    counts = o_rows.agg(
        F.count("*").alias("n_rows_true_o_source"),
        F.count_if(hot).alias("n_rows_hot_subset"),
        F.count_if(hot & (F.col("quality_state") == "pass")).alias("n_rows_hot_pass"),
    )

    def part(a, b):
        return F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))

    return counts.select(
        F.lit(float(min_teff)).alias("teff_min_k"),
        "n_rows_true_o_source",
        "n_rows_hot_subset",
        part("n_rows_hot_subset", "n_rows_true_o_source").alias("share_hot_subset_in_source"),
        "n_rows_hot_pass",
        part("n_rows_hot_pass", "n_rows_hot_subset").alias("share_hot_pass_in_hot_subset"),
        F.col("n_rows_hot_pass").alias("n_rows_hot_scored"),
    )


# --- secure O -------------------------------------------------------------------------

SECURE_O_COLUMNS = (
    "source_id",
    "raw_sptype",
    "spectral_class",
    "spectral_subclass",
    "spectraltype_esphs",
    "esphs_class_letter",
    "flags_esphs",
    "in_gold_sample_oba_stars",
    "teff_gspphot",
    "teff_esphs",
    "logg_gspphot",
    "radius_flame",
    "lum_flame",
)


def secure_o_tail(policy_rows: DataFrame, labeled: DataFrame, limit: int | None = None) -> DataFrame:
    """Secure O rows with their catalogue label."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    secure = policy_rows.where(
        (F.col("ob_policy_bucket") == "secure_o_like") & (F.col("spectral_class") == "O")
    ).drop("raw_sptype")
    out = secure.join(labeled.select("source_id", "raw_sptype"), "source_id")
    have = set(out.columns)
    out = out.select(*[c for c in (*SECURE_O_COLUMNS, "logg_esphs") if c in have])
    return out if limit is None else out.orderBy("source_id").limit(limit)


def secure_o_summary(tail: DataFrame) -> DataFrame:
    base = tail.agg(
        F.count("*").alias("n_rows"),
        F.count("spectral_subclass").alias("n_with_numeric_subclass"),
        F.count("teff_esphs").alias("n_with_teff_esphs"),
        F.count_if(F.coalesce("in_gold_sample_oba_stars", F.lit(False))).alias("n_in_gold_sample_oba"),
    )
    med = medians(
        tail,
        [],
        {"median_teff_gspphot": "teff_gspphot", "median_teff_esphs": "teff_esphs", "median_lum_flame": "lum_flame"},
    )
    return base.withColumns({c: med.select(c).scalar() for c in med.columns})


def secure_o_esphs(tail: DataFrame) -> DataFrame:
    return tail.groupBy(
        "spectraltype_esphs", "flags_esphs", F.col("teff_esphs").isNotNull().alias("has_teff_esphs")
    ).agg(F.count("*").alias("n_rows"))


COMPARED = ("teff_gspphot", "logg_gspphot", "radius_gspphot", "parallax")


def reference_groups(secure: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Secure O rows and the reference groups stacked."""

    def part(df, name):
        return df.select(F.lit(name).alias("comparison_group"), "source_id", *COMPARED)

    out = part(secure, "secure_o_tail")
    for name, df in references.items():
        out = out.unionByName(part(df, name))
    return out


def reference_distances(stacked: DataFrame) -> DataFrame:
    """Distance of each group's medians to those of the secure group."""
    levels = physics_summary(stacked, ["comparison_group"], COMPARED)
    own = levels.where(F.col("comparison_group") == "secure_o_tail")
    rest = levels.where(F.col("comparison_group") != "secure_o_tail")
    return rest.select(
        "comparison_group",
        *[
            F.abs(F.col(f"median_{f}") - own.select(f"median_{f}").scalar()).alias(f"abs_diff_{f}")
            for f in COMPARED
        ],
    )


# --- support of class O ---------------------------------------------------------------


def teff_band(c: Column, edges=TEFF_BANDS_K) -> Column:
    out = F.when(c.isNull(), "missing").when(c < edges[0], f"< {edges[0]} K")
    for low, high in zip(edges, edges[1:]):
        out = out.when(c < high, f"{low}-{high - 1} K")
    return out.otherwise(f">= {edges[-1]} K")


def with_full(split: DataFrame) -> DataFrame:
    """Every row once under its split and once under `full`."""
    return split.withColumn("split_name", F.explode(F.array(F.lit("full"), F.col("split_name"))))


def is_o() -> Column:
    return F.upper("spec_class") == "O"


def o_split_support(split: DataFrame) -> DataFrame:
    """Class O in each split and its part of all O rows."""
    counts = (
        with_full(split)
        .groupBy("split_name")
        .agg(F.count("*").alias("n_rows_split"), F.count_if(is_o()).alias("n_rows_true_o"))
    )
    total = counts.where("split_name = 'full'").select("n_rows_true_o").scalar()
    return counts.withColumns(
        {
            "share_true_o_in_split": F.col("n_rows_true_o") / F.col("n_rows_split"),
            "share_true_o_of_total_o": F.col("n_rows_true_o") / total,
        }
    )


def o_support_by(split: DataFrame, column: Column, name: str) -> DataFrame:
    counts = (
        with_full(split.where(is_o()))
        .groupBy("split_name", column.alias(name))
        .agg(F.count("*").alias("n_rows"))
    )
    return with_share(counts, name="share_within_split_true_o", within=["split_name"])


def hot_ob_support(split: DataFrame, min_teff: float = C.HOT_TEFF_K) -> DataFrame:
    hot = split.where(F.upper("spec_class").isin("O", "B") & (F.col("teff_gspphot") >= min_teff))
    counts = with_full(hot).groupBy("split_name", "spec_class").agg(F.count("*").alias("n_rows"))
    return with_share(counts, name="share_within_hot_boundary", within=["split_name"])


def o_physics(split: DataFrame) -> DataFrame:
    features = ("teff_gspphot", "logg_gspphot", "bp_rp", "radius_feature", "radius_flame")
    return physics_summary(with_full(split.where(is_o())), ["split_name"], features).withColumnRenamed(
        "n_rows", "n_rows_true_o"
    )


def split_row_match(split: DataFrame, benchmark_rows: DataFrame) -> DataFrame:
    """Rows per split against the row counts a benchmark recorded."""
    counts = with_full(split).groupBy("split_name").agg(F.count("*").alias("n_rows_reconstructed"))
    return null_safe_join(counts, benchmark_rows, ["split_name"]).withColumn(
        "is_match", F.col("n_rows_reconstructed") == F.col("n_rows_benchmark")
    )


def hottest_o(split: DataFrame, top_n: int = 20) -> DataFrame:
    names = (
        "source_id", "spec_class", "evolution_stage", *C.CORE_FEATURES, "radius_feature", "radius_flame", "split_name",
    )
    have = set(split.columns)
    return (
        split.where(is_o())
        .select(*[c for c in names if c in have])
        .orderBy(F.desc("teff_gspphot"), "split_name", "source_id")
        .limit(top_n)
    )

