"""Training frames: label clean-up, number clean-up, required cells, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import labels as LB
from skysieve.functions.numeric import clean_text, coerce_numbers
from skysieve.operators import guards as G
from skysieve.operators.ordered import small_table
from skysieve.sources.relations import project


def keep_supported(df: DataFrame, target: str, min_count: int) -> DataFrame:
    """Rows whose label has at least `min_count` rows.

    Labels are counted first; the table of frequent labels is broadcast when it is
    small, so rows of a dominant label are not gathered anywhere.
    """
    frequent = (
        df.groupBy(target).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select(target)
    )
    return df.join(small_table(frequent), target, "left_semi")


def task_ready(df: DataFrame, target: str, what: str = "task frame") -> DataFrame:
    """Rows with a target; an empty result is an error."""
    G.require_columns(df, (target,), what)
    rows = df.where(F.col(target).isNotNull())
    if rows.limit(1).count() == 0:
        raise ValueError(f"{what} has no rows with {target}")
    return rows


def normalize_labels(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "spec_class": LB.normalize_class(F.col("spec_class")),
            "evolution_stage": LB.normalize_stage(F.col("evolution_stage")),
        }
    )
    if "spec_subclass" in df.columns:
        out = out.withColumn("spec_subclass", LB.normalize_subclass(F.col("spec_subclass")))
    return out


def _checked(df: DataFrame, what: str, violations: DataFrame, check: bool) -> DataFrame:
    if check:
        G.require_no_violations(violations, what)
        G.require_unique(df, what)
    return df


def router_frame(df: DataFrame, *, check: bool = True) -> DataFrame:
    """Labels, numbers, required cells, label and id checks."""
    out = coerce_numbers(normalize_labels(project(df, C.ROUTER_TRAINING)), C.NUMERIC_COLUMNS)
    out = out.na.drop(subset=list(C.ROUTER_TRAINING.required))
    return _checked(out, C.ROUTER_TRAINING.name, G.label_violations(out), check)


def host_frame(df: DataFrame, *, check: bool = True) -> DataFrame:
    """As the router frame; odd subclasses become missing and FLAME supplies the radius."""
    out = normalize_labels(project(df, C.HOST_TRAINING))
    if "spec_subclass" in out.columns:
        out = out.withColumn("spec_subclass", LB.canonical_subclass(F.col("spec_subclass")))
    out = coerce_numbers(out, C.NUMERIC_COLUMNS)
    if "radius_gspphot" in out.columns:
        out = out.withColumn("radius_gspphot_legacy", F.col("radius_gspphot"))
    out = out.withColumn("radius_gspphot", F.col("radius_flame"))
    out = out.na.drop(subset=list(C.HOST_TRAINING.required))
    return _checked(out, C.HOST_TRAINING.name, G.label_violations(out), check)


def coarse_frame(df: DataFrame, *, check: bool = True) -> DataFrame:
    out = project(df, C.COARSE_TRAINING).withColumns(
        {
            "spec_class": LB.normalize_class(F.col("spec_class")),
            "evolution_stage": LB.stage_of_flag(F.col("is_evolved")),
        }
    )
    out = coerce_numbers(out, C.NUMERIC_COLUMNS).na.drop(
        subset=["source_id", "spec_class", *C.CORE_FEATURES]
    )
    return _checked(out, C.COARSE_TRAINING.name, G.label_violations(out), check)


def refinement_frame(df: DataFrame, *, check: bool = True) -> DataFrame:
    """Full subclass labels, stage from luminosity, labels with enough rows."""
    out = project(df, C.REFINEMENT_TRAINING).withColumnsRenamed(
        {"spectral_class": "spec_class", "spectral_subclass": "spec_subclass"}
    )
    out = out.withColumn("spec_class", LB.normalize_class(F.col("spec_class")))
    out = out.withColumn("spec_subclass", LB.full_subclass(F.col("spec_class"), F.col("spec_subclass")))
    if "luminosity_class" in out.columns:
        out = out.withColumn("luminosity_class", clean_text(F.col("luminosity_class")))
        stage = LB.stage_of_luminosity(F.col("luminosity_class"))
    else:
        stage = F.lit(None).cast("string")
    out = out.withColumns({"evolution_stage": stage, "radius_gspphot": F.col("radius_flame")})
    out = coerce_numbers(out, C.NUMERIC_COLUMNS).na.drop(
        subset=["source_id", "spec_class", "spec_subclass", *C.CORE_FEATURES, "radius_flame"]
    )
    if check:
        G.require_no_violations(G.label_violations(out), C.REFINEMENT_TRAINING.name)
    out = keep_supported(out, "spec_subclass", C.MIN_SUBCLASS_SUPPORT)
    if check:
        G.require_unique(out, C.REFINEMENT_TRAINING.name)
    return out


def family_frame(df: DataFrame, spectral_class: str, *, check: bool = True) -> DataFrame:
    """Digit targets of one family."""
    family = C.require_family(spectral_class)
    out = project(df, C.FAMILY_TRAINING).withColumns(
        {
            "spectral_class": LB.normalize_class(F.col("spectral_class")),
            "spectral_subclass": LB.family_digit(F.col("spectral_subclass"), family),
        }
    )
    out = out.withColumn("full_subclass_label", F.concat("spectral_class", "spectral_subclass"))
    out = coerce_numbers(out, (*C.NUMERIC_COLUMNS, "evolstage_flame")).na.drop(
        subset=["source_id", "spectral_class", "spectral_subclass", *C.FAMILY_FEATURES]
    )
    return _checked(out, C.FAMILY_TRAINING.name, G.family_violations(out, family), check)


# --- ID/OOD ---------------------------------------------------------------------------


MEMBERSHIP_COLUMNS = ("ood_group", "ood_membership_count", "selector_score_1", "selector_score_2")


def target_conflicts(df: DataFrame) -> DataFrame:
    """Ids that carry more than one domain target."""
    target = F.lower(F.trim("domain_target"))
    return (
        df.groupBy("source_id")
        .agg(F.min(target).alias("a"), F.max(target).alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("source_id")
    )


def collapse_memberships(df: DataFrame) -> DataFrame:
    """One row per id out of several out-of-domain memberships.

    The first row by (random_index, domain_target, source_id, ood_group) carries
    the collapsed group. All parts are aggregates that combine on the map side;
    the member list is bounded by the vocabulary of groups.
    """
    have = [c for c in df.columns if c != "source_id"]
    for absent in MEMBERSHIP_COLUMNS:
        if absent not in have:
            df = df.withColumn(absent, F.lit(None))
    order = [c for c in ("random_index", "domain_target", "ood_group") if c in have]
    group = F.col("ood_group").cast("string")
    per_id = df.groupBy("source_id").agg(
        F.count("*").alias("_n"),
        F.min_by(F.struct(*have), F.struct(*order)).alias("_first"),
        F.array_sort(F.collect_set(F.when(F.trim(group) != "", group))).alias("_groups"),
        F.max("ood_membership_count").alias("_count"),
        F.max("selector_score_1").alias("_s1"),
        F.max("selector_score_2").alias("_s2"),
    )
    many, members = F.col("_n") > 1, F.size("_groups")
    merged = {
        "ood_group": F.when(members > 1, "multi_ood").otherwise(F.col("_first.ood_group")),
        "ood_membership_count": F.coalesce("_count", members.cast("double")),
        "has_multi_ood_membership": F.lit(True),
        "selector_score_1": F.col("_s1"),
        "selector_score_2": F.col("_s2"),
    }
    cells = [
        (F.when(many, merged[c]).otherwise(F.col(f"_first.{c}")) if c in merged else F.col(f"_first.{c}")).alias(c)
        for c in have
    ]
    list_text = F.when(many & (members > 0), F.array_join("_groups", ",")).alias("ood_group_members")
    return per_id.select("source_id", *cells, list_text)


def ood_frame(df: DataFrame, *, check: bool = True) -> DataFrame:
    out = project(df, C.OOD_TRAINING).withColumn("domain_target", F.lower(F.trim("domain_target")))
    out = coerce_numbers(out, C.NUMERIC_COLUMNS).na.drop(
        subset=["source_id", "domain_target", *C.CORE_FEATURES]
    )
    if check:
        G.require_no_violations(G.domain_violations(out), C.OOD_TRAINING.name)
        bad = [str(r[0]) for r in target_conflicts(out).orderBy("source_id").limit(G.SAMPLE).collect()]
        if bad:
            raise ValueError(f"conflicting domain_target values for source_id: {', '.join(bad)}")
    return collapse_memberships(out)
