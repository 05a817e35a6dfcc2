"""Working layers between the catalogue and the training views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.policy import first_rule
from skysieve.operators.distributions import count_flags
from skysieve.operators.guards import require_columns
from skysieve.operators.ordered import grouped_summary, null_safe_join, small_table
from skysieve.operators.skew import broadcast_ids, by_shuffle

MIN_SINGLE_STAR_PROBABILITY = 0.5


def all_present(names) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def yes(test: Column) -> Column:
    """True only where the test is known to hold."""
    return F.coalesce(test, F.lit(False))


def mark_members(df: DataFrame, pool: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows with `in_ood_reference`: whether the out-of-domain reference holds the id in `key`.

    Beyond the limit of `broadcast_ids` the rows are shuffled, so mark them before formulas widen them.
    """
    ids = pool.select(F.col("source_id").alias(key)).distinct()
    members = broadcast_ids(ids).withColumn("in_ood_reference", F.lit(True))
    return df.join(members, key, "left").withColumn("in_ood_reference", yes(F.col("in_ood_reference")))


def initial_gate(
    df: DataFrame, ood_pool: DataFrame | None = None, policy: C.GatePolicy = C.GatePolicy()
) -> DataFrame:
    """First quality and domain states of a training reference.

    Reasons follow the order RUWE, parallax SNR, FLAME. In the review bucket the
    domain suspicions outrank those quality reasons; a reject outranks both.
    Without a pool, rows that `mark_members` has marked keep their flag.
    """
    out = df.withColumns(
        {
            "has_core_features": all_present(C.CORE_FEATURES),
            "has_flame_features": F.col("radius_flame").isNotNull(),
            "has_non_single_star_flag": yes(F.col("non_single_star") > 0),
            "has_low_single_star_probability": yes(
                F.col("classprob_dsc_combmod_star") < MIN_SINGLE_STAR_PROBABILITY
            ),
            "has_missing_core_features": ~all_present(C.CORE_FEATURES),
            "has_missing_flame_features": F.col("radius_flame").isNull(),
            "has_high_ruwe": yes(F.col("ruwe") > policy.max_ruwe),
            "has_low_parallax_snr": yes(F.col("parallax_over_error") < policy.min_parallax_snr),
        }
    )
    if ood_pool is not None:
        out = mark_members(out, ood_pool)
    elif "in_ood_reference" not in out.columns:
        out = out.withColumn("in_ood_reference", F.lit(False))
    reject = (F.col("has_missing_core_features"), "reject_missing_core_features")
    quality = [
        (F.col("has_high_ruwe"), "review_high_ruwe"),
        (F.col("has_low_parallax_snr"), "review_low_parallax_snr"),
        (F.col("has_missing_flame_features"), "review_missing_radius_flame"),
    ]
    suspicion = [
        (F.col("has_non_single_star_flag"), "review_non_single_star"),
        (F.col("has_low_single_star_probability"), "review_low_single_star_probability"),
    ]
    return out.withColumn("quality_reason", first_rule([reject, *quality], "pass")).withColumns(
        {
            "quality_state": F.when(F.col("quality_reason") == "pass", "pass")
            .when(F.col("has_missing_core_features"), "reject")
            .otherwise("unknown"),
            "ood_state": first_rule(
                [
                    (F.col("in_ood_reference"), "ood"),
                    (suspicion[0][0] | suspicion[1][0], "candidate_ood"),
                ],
                "in_domain",
            ),
            "ood_reason": first_rule(
                [
                    (F.col("in_ood_reference"), "ood_reference_member"),
                    (suspicion[0][0], "non_single_star"),
                    (suspicion[1][0], "low_single_star_probability"),
                ]
            ),
            "review_bucket": first_rule([reject, *suspicion, *quality], "pass"),
        }
    )


def review_rows(gated: DataFrame) -> DataFrame:
    """Everything that is not plainly usable."""
    return gated.where(
        ~F.col("quality_state").eqNullSafe(F.lit("pass"))
        | ~F.col("ood_state").eqNullSafe(F.lit("in_domain"))
    )


def training_reference(labeled: DataFrame, core: DataFrame, flame: DataFrame) -> DataFrame:
    """Conflict-free labels with core and FLAME parameters and presence flags."""
    out = (
        labeled.where(~F.col("has_source_conflict"))
        .join(by_shuffle(core), "source_id", "left")
        .join(by_shuffle(flame), "source_id", "left")
    )
    return out.withColumns(
        {
            "has_core_features": all_present(C.CORE_FEATURES),
            "has_flame_features": F.col("radius_flame").isNotNull(),
        }
    )


def enrich(ids: DataFrame, parameters: DataFrame, *columns: str) -> DataFrame:
    """Parameters beside requested ids; unknown ids stay with NULLs."""
    return ids.join(by_shuffle(parameters.select("source_id", *columns)), "source_id", "left")


def sync_fields(target: DataFrame, source: DataFrame, keys, fields, *, where: Column | None = None) -> DataFrame:
    """Target rows with `fields` taken from the matching source row where any differs.

    Adds `is_updated`. A key that repeats in the source is an error when a target row meets it, as an
    UPDATE could take either row. `where` limits which target rows may change.
    """
    keys, fields = list(keys), list(fields)
    repeated = F.raise_error(F.concat_ws(", ", F.lit("key repeats in the source: "), *[F.col(k).cast("string") for k in keys]))
    new = (
        source.groupBy(*keys)
        .agg(*[F.first(f).alias(f"_new_{f}") for f in fields], F.count("*").alias("_hits"))
        .withColumn("_hit", F.when(F.col("_hits") == 1, True).otherwise(repeated.cast("boolean")))
        .drop("_hits")
    )
    joined = target.join(new, keys, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_new_{f}")) for f in fields])
    changed = yes(F.col("_hit")) & differs
    if where is not None:
        changed = changed & yes(where)
    return (
        joined.withColumn("is_updated", changed)
        .withColumns({f: F.when(F.col("is_updated"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields})
        .drop("_hit", *[f"_new_{f}" for f in fields])
    )


def sync_parser_fields(target: DataFrame, labeled: DataFrame, catalog: str = "bmk") -> DataFrame:
    return sync_fields(
        target,
        labeled.where(F.col("external_catalog_name") == catalog),
        ("xmatch_batch_id", "source_id", "external_row_id"),
        C.PARSER_FIELDS,
        where=F.col("external_catalog_name") == catalog,
    )


def sync_provenance(audit: DataFrame, source: DataFrame) -> DataFrame:
    """Refresh the local fields of the hot O/B audit table; stamps compare as text."""
    fields = [f for f in C.PROVENANCE_FIELDS if f in audit.columns and f in source.columns]
    if "quality_gated_at_utc" in fields:
        source = source.withColumn("quality_gated_at_utc", F.col("quality_gated_at_utc").cast("string"))
    return sync_fields(audit, source, ("source_id",), fields)


def support_audit(df: DataFrame, min_rows: int = C.MIN_SUBCLASS_SUPPORT) -> DataFrame:
    """Rows per class and full subclass with the keep flag."""
    return (
        df.where(F.col("spectral_subclass").isNotNull())
        .groupBy(
            "spectral_class",
            F.concat("spectral_class", F.col("spectral_subclass").cast("string")).alias("full_subclass"),
        )
        .agg(F.count("*").alias("n_rows"))
        .withColumn("keep_ge_15", F.col("n_rows") >= min_rows)
    )


def family_training_rows(df: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows fit for the subclass models, all families in one table.

    Written partitioned by `spectral_class`, a family is one pruned partition.
    """
    keep = audit.where("keep_ge_15").select("spectral_class", F.col("full_subclass").alias("full_subclass_label"))
    usable = df.where(
        F.col("spectral_class").isin(*C.REFINED_CLASSES)
        & (F.col("quality_state") == "pass")
        & (F.col("ood_state") == "in_domain")
        & all_present(C.FAMILY_FEATURES)
    ).withColumn(
        "full_subclass_label",
        F.concat("spectral_class", F.col("spectral_subclass").cast("string")),
    )
    return usable.join(small_table(keep), ["spectral_class", "full_subclass_label"], "left_semi")


def family_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("spectral_class").agg(
        F.count("*").alias("rows_loaded"),
        F.countDistinct("source_id").alias("distinct_source_ids"),
        F.countDistinct("spectral_subclass").alias("distinct_subclasses"),
    )


# --- O/B boundary ---------------------------------------------------------------------


def hot_ob_source(gated: DataFrame, min_teff: float = C.HOT_TEFF_K) -> DataFrame:
    """Passed hot O, B and OB rows with the provenance fields."""
    have = set(gated.columns)
    return gated.where(
        (F.col("quality_state") == "pass")
        & F.col("spectral_class").isin("O", "B", "OB")
        & (F.col("teff_gspphot") >= min_teff)
    ).select("source_id", *[c for c in C.PROVENANCE_FIELDS if c in have])


def ob_policy(df: DataFrame) -> DataFrame:
    """Split O and OB rows into a secure and a boundary part (U06); one column, no union."""
    require_columns(
        df,
        ("source_id", "spectral_class", "esphs_class_letter", "flags_esphs", "teff_esphs"),
        "O/B policy source",
    )
    secure = yes(
        (F.col("esphs_class_letter") == "O") & (F.coalesce("flags_esphs", F.lit(-1)) != 999)
    )
    return df.where(F.col("spectral_class").isin("O", "OB")).withColumns(
        {
            "ob_policy_version": F.lit(C.OB_POLICY_VERSION),
            "ob_policy_bucket": F.when(secure, "secure_o_like").otherwise("ob_boundary"),
            "ob_policy_reason": F.when(secure, "esphs_o_non999")
            .when(F.col("spectral_class") == "OB", "ambiguous_ob_label")
            .otherwise("explicit_o_not_confirmed_by_esphs"),
        }
    )


def ob_policy_summary(policy_rows: DataFrame) -> DataFrame:
    letter = F.col("esphs_class_letter")
    return grouped_summary(
        policy_rows.withColumn("local_spectral_class", F.col("spectral_class")),
        ["ob_policy_bucket", "local_spectral_class"],
        [
            F.count("*").alias("n_rows"),
            *count_flags({"n_esphs_o": letter == "O", "n_esphs_b": letter == "B", "n_esphs_u": letter == "U"}),
        ],
        {"median_teff_esphs": "teff_esphs"},
    )


def ob_review_pool(policy_rows: DataFrame) -> DataFrame:
    """Boundary rows marked for review."""
    return policy_rows.where(F.col("ob_policy_bucket") == "ob_boundary").withColumns(
        {"ob_review_state": F.lit("review"), "ob_review_reason": F.col("ob_policy_reason")}
    )


def ob_review_summary(pool: DataFrame) -> DataFrame:
    return grouped_summary(
        pool.withColumn("local_spectral_class", F.col("spectral_class")),
        ["local_spectral_class", "ob_review_reason", "esphs_class_letter"],
        [F.count("*").alias("n_rows")],
        {"median_teff_esphs": "teff_esphs"},
    )


def provenance_summary(audit: DataFrame) -> DataFrame:
    letter, gold = F.col("esphs_class_letter"), yes(F.col("in_gold_sample_oba_stars"))

    def share(test):
        return F.avg(F.when(test, 1.0).otherwise(0.0))

    return grouped_summary(
        audit,
        ["spectral_class"],
        [
            F.count("*").alias("n_rows"),
            *count_flags(
                {
                    "n_in_gold_sample_oba_stars": gold,
                    "n_with_esphs_type": F.col("spectraltype_esphs").isNotNull(),
                    "n_esphs_o": letter == "O",
                    "n_esphs_b": letter == "B",
                    "n_esphs_a": letter == "A",
                }
            ),
            share(gold).alias("gold_sample_share"),
            share(letter == "O").alias("esphs_o_share"),
            share(letter == "B").alias("esphs_b_share"),
            share(letter == "A").alias("esphs_a_share"),
        ],
        {
            "median_teff_gspphot": "teff_gspphot",
            "median_teff_esphs": "teff_esphs",
            "median_radius_flame": "radius_flame",
            "median_radius_gspphot": "radius_gspphot",
        },
    )


def crosswalk_summary(audit: DataFrame) -> DataFrame:
    """Local class against ESPHS letter with the share inside the local class."""
    known = audit.where(F.col("spectral_class").isNotNull())
    cells = grouped_summary(
        known,
        ["spectral_class", "esphs_class_letter"],
        [
            F.count("*").alias("n_rows"),
            F.count_if(yes(F.col("in_gold_sample_oba_stars"))).alias("n_in_gold_sample_oba_stars"),
        ],
        {
            "median_teff_gspphot": "teff_gspphot",
            "median_teff_esphs": "teff_esphs",
            "median_radius_flame": "radius_flame",
        },
    )
    totals = cells.groupBy("spectral_class").agg(F.sum("n_rows").alias("n_local_class_rows"))
    return null_safe_join(cells, totals, ["spectral_class"]).withColumn(
        "share_within_local_class", F.col("n_rows") / F.col("n_local_class_rows")
    )


# --- training views and layer summaries -----------------------------------------------


def coarse_training_view(df: DataFrame) -> DataFrame:
    """Labelled rows with all core features; the radius falls back per row."""
    return df.where(F.col("spec_class").isNotNull() & all_present(C.CORE_FEATURES)).withColumn(
        "radius_feature", F.coalesce("radius_flame", "radius_gspphot")
    )


def refinement_training_view(gated: DataFrame) -> DataFrame:
    """Clean rows with a subclass that is frequent enough."""
    clean = gated.where(
        (F.col("quality_state") == "pass")
        & (F.col("ood_state") == "in_domain")
        & F.col("spectral_subclass").isNotNull()
        & all_present((*C.CORE_FEATURES, "radius_flame"))
    )
    enough = (
        clean.groupBy("spectral_class", "spectral_subclass")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= C.MIN_SUBCLASS_SUPPORT)
        .drop("_n")
    )
    return clean.join(small_table(enough), ["spectral_class", "spectral_subclass"], "left_semi")


def id_ood_training_view(gated: DataFrame, ood_reference: DataFrame) -> DataFrame:
    """Clean in-domain rows and the out-of-domain reference in one table."""
    inside = gated.where(
        (F.col("quality_state") == "pass")
        & (F.col("ood_state") == "in_domain")
        & all_present(C.CORE_FEATURES)
    ).withColumn("domain_target", F.lit("id"))
    outside = ood_reference.where(all_present(C.CORE_FEATURES)).withColumn("domain_target", F.lit("ood"))
    names = (*C.OOD_TRAINING.required, *C.OOD_TRAINING.optional)

    def pick(df):
        have = set(df.columns)
        return df.select(*[n for n in names if n in have])

    return pick(inside).unionByName(pick(outside), allowMissingColumns=True)


def training_summary(reference: DataFrame) -> DataFrame:
    status = F.col("label_parse_status")
    return reference.groupBy("spectral_class").agg(
        F.count("*").alias("row_count"),
        *count_flags(
            {
                "subclass_rows": F.col("spectral_subclass").isNotNull(),
                "luminosity_rows": F.col("luminosity_class").isNotNull(),
                "core_feature_rows": F.col("has_core_features"),
                "flame_feature_rows": F.col("has_flame_features"),
                "parsed_rows": status == "parsed",
                "partial_rows": status == "partial",
            }
        ),
    )


def state_summary(gated: DataFrame) -> DataFrame:
    return gated.groupBy("quality_state", "ood_state").agg(F.count("*").alias("row_count"))


def bucket_summary(review: DataFrame) -> DataFrame:
    return (
        review.groupBy("review_bucket")
        .agg(F.count("*").alias("row_count"))
        .orderBy(F.asc_nulls_last("review_bucket"))
    )


def sync_summary(rows: DataFrame) -> DataFrame:
    """Ambiguous O/B spellings still called O, and the O and OB totals."""
    label = F.col("spectral_class")
    return rows.agg(
        *count_flags(
            {
                "ambiguous_ob_rows": (label == "O")
                & F.col("raw_sptype").rlike("^(OB|O/B|O[0-9]+(\\.[0-9]+)?/B)"),
                "ob_rows": label == "OB",
                "o_rows": label == "O",
            }
        )
    )
