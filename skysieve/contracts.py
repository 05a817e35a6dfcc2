"""Table contracts, feature lists, tasks and policies.

Everything here is driver-side configuration: frozen dataclasses that become
literals or `select` lists in a plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# --- fixed values: label vocabularies -------------------------------------------------

SPECTRAL_CLASSES = ("O", "B", "A", "F", "G", "K", "M")
TARGET_CLASSES = ("F", "G", "K", "M")
LOW_PRIORITY_CLASSES = ("O", "B", "A")

# fixed values: the texts that a ranking gives as reasons, in rule order
PRIORITY_REASONS = {
    "low_priority_class": "упрощенная low-priority ветка по спектральному классу",
    "evolved_stage_penalty": "штраф за evolved-стадию",
    "strong_host_signal": "сильный host-like сигнал",
    "weak_host_signal": "слабый host-like сигнал",
    "good_observability": "хорошая наблюдательная пригодность",
    "limited_observability": "ограниченная наблюдательная пригодность",
    "observability_without_inputs": "observability рассчитана по нейтральному fallback без входных сигналов",
    "observability_with_partial_inputs": "observability рассчитана по неполному набору сигналов",
    "balanced_profile": "сбалансированный профиль без явных экстремумов",
}
REFINED_CLASSES = ("A", "B", "F", "G", "K", "M")
STAGES = ("dwarf", "evolved")
STAGE_ALIASES = {"subgiant": "evolved", "giant": "evolved"}
SOURCE_STAGES = ("dwarf", "evolved", "subgiant", "giant")
DOMAIN_TARGETS = ("id", "ood")
SUBCLASS_PATTERN = "^[OBAFGKM][0-9]$"
DWARF_LUMINOSITY_CODES = ("V", "VI", "VII")
EVOLVED_LUMINOSITY_CODES = ("0", "IA+", "IA", "IAB", "IB", "I", "II", "III", "IV")
MIN_SUBCLASS_SUPPORT = 15
HOT_TEFF_K = 10_000.0
BATCH_ID_PATTERN = "^[A-Za-z0-9_:-]+$"
OB_POLICY_VERSION = "coarse_ob_boundary_policy_v1"

# --- fixed values: feature lists ------------------------------------------------------

CORE_FEATURES = (
    "teff_gspphot",
    "logg_gspphot",
    "mh_gspphot",
    "bp_rp",
    "parallax",
    "parallax_over_error",
    "ruwe",
)
ROUTER_FEATURES = (
    "teff_gspphot",
    "logg_gspphot",
    "radius_gspphot",
    "parallax",
    "parallax_over_error",
    "ruwe",
    "bp_rp",
    "mh_gspphot",
)
COARSE_FEATURES = (*CORE_FEATURES, "radius_feature")
OOD_FEATURES = (*CORE_FEATURES, "phot_g_mean_mag")
REFINEMENT_FEATURES = (*CORE_FEATURES, "radius_flame", "lum_flame", "phot_g_mean_mag")
FAMILY_FEATURES = (
    *CORE_FEATURES,
    "radius_flame",
    "lum_flame",
    "evolstage_flame",
    "phot_g_mean_mag",
)
QUALITY_FEATURES = ("parallax_over_error", "ruwe", "validation_factor")
OBSERVABILITY_FEATURES = ("ra", "dec", "parallax", "phot_g_mean_mag")
HOST_CORE_FEATURES = (*CORE_FEATURES, "radius_flame")
HOST_OBSERVABILITY_FEATURES = ("ra", "dec", "phot_g_mean_mag")
HOST_CONTEXT_FEATURES = ("spec_class", "evolution_stage", "spec_subclass")
HOST_OPTIONAL_FEATURES = ("lum_flame", "evolstage_flame", "radius_gspphot")
HOST_ALL_FEATURES = (
    *HOST_CORE_FEATURES,
    *HOST_OBSERVABILITY_FEATURES,
    *HOST_CONTEXT_FEATURES,
    *HOST_OPTIONAL_FEATURES,
)
RANKING_OPTIONAL_COLUMNS = (
    "evolution_stage",
    "parallax",
    "phot_g_mean_mag",
    "parallax_over_error",
    "ruwe",
    "validation_factor",
)
GATE_SIGNAL_COLUMNS = (
    "has_core_features",
    "has_flame_features",
    "has_non_single_star_flag",
    "has_low_single_star_probability",
    "has_missing_core_features",
    "has_missing_flame_features",
    "has_high_ruwe",
    "has_low_parallax_snr",
)

# feature -> columns that may stand in for it, first present one wins
FEATURE_STAND_INS = {
    "radius_feature": ("radius_flame", "radius_gspphot"),
    "radius_gspphot": ("radius_flame",),
}


def ordered_union(*groups: tuple[str, ...]) -> tuple[str, ...]:
    """Names of all groups in order of first appearance."""
    return tuple(dict.fromkeys(name for group in groups for name in group))


# --- table contracts ------------------------------------------------------------------


@dataclass(frozen=True)
class TableContract:
    """Columns a relation must have, and those taken along when present."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()

    def missing(self, available) -> list[str]:
        have = set(available)
        return [c for c in dict.fromkeys(self.required) if c not in have]

    def columns(self, available) -> list[str]:
        have = set(available)
        extra = tuple(c for c in self.optional if c in have)
        return list(ordered_union(self.required, extra))


ROUTER_TRAINING = TableContract(
    "router training frame",
    required=(
        "source_id",
        "ra",
        "dec",
        "teff_gspphot",
        "logg_gspphot",
        "radius_gspphot",
        "spec_class",
        "evolution_stage",
    ),
    optional=(
        "spec_subclass",
        "parallax",
        "parallax_over_error",
        "ruwe",
        "mh_gspphot",
        "bp_rp",
        "source_type",
        "random_index",
    ),
)

HOST_TRAINING = TableContract(
    "host training frame",
    required=(
        "source_id",
        "teff_gspphot",
        "logg_gspphot",
        "radius_flame",
        "spec_class",
        "evolution_stage",
    ),
    optional=(
        "hostname",
        "spec_subclass",
        "ra_gaia",
        "dec_gaia",
        "dist_arcsec",
        "parallax",
        "parallax_over_error",
        "ruwe",
        "phot_g_mean_mag",
        "bp_rp",
        "mh_gspphot",
        "radius_gspphot",
        "lum_flame",
        "evolstage_flame",
        "non_single_star",
        "classprob_dsc_combmod_star",
        "validation_factor",
    ),
)

COARSE_TRAINING = TableContract(
    "coarse training frame",
    required=("source_id", "ra", "dec", *CORE_FEATURES, "spec_class", "is_evolved"),
    optional=(
        "random_index",
        "radius_feature",
        "radius_flame",
        "radius_gspphot",
        "lum_flame",
        "evolstage_flame",
        "reference_membership_count",
        "has_reference_overlap",
    ),
)

_LABEL_PROVENANCE = (
    "luminosity_class",
    "peculiarity_suffix",
    "raw_sptype",
    "label_parse_status",
    "label_parse_notes",
    "xmatch_batch_id",
    "external_row_id",
    "external_catalog_name",
    "external_object_id",
    "xmatch_separation_arcsec",
    "quality_state",
    "ood_state",
    "quality_reason",
    "ood_reason",
    "quality_gate_version",
    "quality_gated_at_utc",
)

REFINEMENT_TRAINING = TableContract(
    "refinement training frame",
    required=(
        "source_id",
        "spectral_class",
        "spectral_subclass",
        *CORE_FEATURES,
        "radius_flame",
    ),
    optional=(
        "random_index",
        "ra",
        "dec",
        "phot_g_mean_mag",
        "lum_flame",
        "evolstage_flame",
        *_LABEL_PROVENANCE,
    ),
)

FAMILY_TRAINING = TableContract(
    "refinement family training frame",
    required=(
        "source_id",
        "spectral_class",
        "spectral_subclass",
        "full_subclass_label",
        *FAMILY_FEATURES,
    ),
    optional=("random_index", "ra", "dec", *_LABEL_PROVENANCE),
)

OOD_TRAINING = TableContract(
    "id/ood training frame",
    required=("source_id", "domain_target", *CORE_FEATURES),
    optional=(
        "ood_group",
        "ood_membership_count",
        "has_multi_ood_membership",
        "random_index",
        "ra",
        "dec",
        "phot_g_mean_mag",
        "radius_flame",
        "selector_score_1",
        "selector_score_2",
    ),
)

GATE_AUDIT = TableContract(
    "quality gate audit",
    required=(
        "source_id",
        "quality_state",
        "ood_state",
        "quality_reason",
        "ood_reason",
        "review_bucket",
        *GATE_SIGNAL_COLUMNS,
    ),
    optional=(
        "spectral_class",
        "spectral_subclass",
        "luminosity_class",
        "ruwe",
        "parallax",
        "parallax_over_error",
        "non_single_star",
        "classprob_dsc_combmod_star",
        "radius_flame",
        "radius_gspphot",
        "lum_flame",
        "evolstage_flame",
        "phot_g_mean_mag",
        "bp_rp",
        "teff_gspphot",
        "logg_gspphot",
        "mh_gspphot",
        "in_ood_reference",
        "ood_membership_count",
        "ood_group_list",
        "quality_gate_version",
        "quality_gated_at_utc",
        "random_index",
    ),
)

SCORING_OPTIONAL_COLUMNS = ordered_union(
    OBSERVABILITY_FEATURES,
    QUALITY_FEATURES,
    ("spec_class", "evolution_stage", "spec_subclass", "source_type", "random_index"),
)

DECISION_OPTIONAL_COLUMNS = ordered_union(
    OBSERVABILITY_FEATURES,
    QUALITY_FEATURES,
    (
        "spec_class",
        "evolution_stage",
        "spec_subclass",
        "source_type",
        "radius_flame",
        "has_core_features",
        "has_flame_features",
        "has_missing_core_features",
        "has_missing_flame_features",
        "has_high_ruwe",
        "has_low_parallax_snr",
        "random_index",
        "quality_reason",
        "review_bucket",
        "ood_state",
        "ood_reason",
        "quality_gate_version",
        "quality_gated_at_utc",
    ),
)

NUMERIC_COLUMNS = ordered_union(
    ("ra", "dec"),
    CORE_FEATURES,
    (
        "radius_feature",
        "radius_flame",
        "radius_gspphot",
        "lum_flame",
        "phot_g_mean_mag",
        "xmatch_separation_arcsec",
        "selector_score_1",
        "selector_score_2",
        "dist_arcsec",
        "classprob_dsc_combmod_star",
        "validation_factor",
    ),
)

# catalogue layers
RAW_COLUMNS = (
    "external_row_id",
    "external_catalog_name",
    "external_object_id",
    "ra_deg",
    "dec_deg",
    "raw_sptype",
    "raw_magnitude",
    "raw_source_bibcode",
    "raw_notes",
)
FILTERED_COLUMNS = (
    *RAW_COLUMNS,
    "spectral_prefix",
    "spectral_class",
    "spectral_subclass",
    "luminosity_class",
    "parse_status",
    "parse_note",
    "has_supported_prefix",
    "has_coordinates",
    "has_raw_sptype",
    "ready_for_gaia_crossmatch",
)
REJECTED_COLUMNS = (*RAW_COLUMNS, "spectral_prefix", "reject_reason")
UPLOAD_COLUMNS = (
    "external_row_id",
    "external_catalog_name",
    "external_object_id",
    "ra_deg",
    "dec_deg",
    "raw_sptype",
)
LABELED_COLUMNS = (
    "xmatch_batch_id",
    "source_id",
    "external_row_id",
    "external_catalog_name",
    "external_object_id",
    "raw_sptype",
    "spectral_class",
    "spectral_subclass",
    "luminosity_class",
    "peculiarity_suffix",
    "label_parse_status",
    "label_parse_notes",
    "xmatch_separation_arcsec",
    "has_source_conflict",
    "source_conflict_count",
)
PARSER_FIELDS = (
    "spectral_class",
    "spectral_subclass",
    "luminosity_class",
    "peculiarity_suffix",
    "label_parse_status",
    "label_parse_notes",
)
PROVENANCE_FIELDS = (
    "spectral_class",
    "spectral_subclass",
    "luminosity_class",
    "quality_state",
    "quality_reason",
    "review_bucket",
    "ood_state",
    "ood_reason",
    "random_index",
    "ra",
    "dec",
    "phot_g_mean_mag",
    *CORE_FEATURES,
    "radius_flame",
    "radius_gspphot",
    "lum_flame",
    "evolstage_flame",
    "non_single_star",
    "classprob_dsc_combmod_star",
    "quality_gate_version",
    "quality_gated_at_utc",
)


# --- policies -------------------------------------------------------------------------


def _unit(name: str, value: float | None) -> None:
    if value is not None and not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0 and 1, got {value}")


@dataclass(frozen=True)
class GatePolicy:
    """Thresholds of the quality gate; `None` switches a rule off."""

    name: str = "baseline"
    max_ruwe: float | None = 1.4
    min_parallax_snr: float | None = 5.0
    require_flame: bool = True

    def __post_init__(self):
        if self.max_ruwe is not None and self.max_ruwe <= 0:
            raise ValueError("max_ruwe must be positive or None")
        if self.min_parallax_snr is not None and self.min_parallax_snr < 0:
            raise ValueError("min_parallax_snr must not be negative")


# fixed values: the three policies that variant reviews compare
GATE_VARIANTS = (
    GatePolicy(),
    GatePolicy("relaxed", 1.6, 3.0, False),
    GatePolicy("strict", 1.2, 7.0, True),
)


@dataclass(frozen=True)
class OodPolicy:
    """Probability cut between in-domain and out-of-domain."""

    threshold: float
    candidate_threshold: float | None = None
    version: str = "id_ood_threshold_v1"
    name: str = "tuned_threshold"
    metric: str = "balanced_accuracy"
    fit_scope: str = "internal_cv"

    def __post_init__(self):
        _unit("threshold", self.threshold)
        if self.candidate_threshold is not None and not (
            0.0 <= self.candidate_threshold <= self.threshold
        ):
            raise ValueError("candidate_threshold must lie between 0 and threshold")


@dataclass(frozen=True)
class HandoffPolicy:
    """When a coarse class is passed on to subclass refinement."""

    classes: tuple[str, ...] = REFINED_CLASSES
    min_probability: float | None = None
    min_margin: float | None = None

    def __post_init__(self):
        _unit("min_probability", self.min_probability)
        _unit("min_margin", self.min_margin)


@dataclass(frozen=True)
class DecisionPolicy:
    version: str = "final_decision_v1"
    handoff: HandoffPolicy = field(default_factory=HandoffPolicy)
    keep_candidate_ood: bool = True
    min_refinement_confidence: float | None = None

    def __post_init__(self):
        _unit("min_refinement_confidence", self.min_refinement_confidence)


@dataclass(frozen=True)
class PriorityWeights:
    class_priority: float = 0.20
    host_similarity: float = 0.45
    observability: float = 0.35

    def __post_init__(self):
        parts = (self.class_priority, self.host_similarity, self.observability)
        if min(parts) <= 0:
            raise ValueError("priority weights must be positive")
        if not math.isclose(sum(parts), 1.0, rel_tol=0.0, abs_tol=1e-9):
            raise ValueError("priority weights must add up to 1")


@dataclass(frozen=True)
class PriorityThresholds:
    high: float = 0.75
    medium: float = 0.45
    low_class_cap: float = 0.34
    evolved_penalty: float = 0.15

    def __post_init__(self):
        _unit("low_class_cap", self.low_class_cap)
        _unit("evolved_penalty", self.evolved_penalty)
        if not 0.0 <= self.medium <= self.high <= 1.0:
            raise ValueError("need 0 <= medium <= high <= 1")


@dataclass(frozen=True)
class LabelVariant:
    """One pair of priority cuts of a threshold review."""

    name: str
    high: float
    medium: float

    def __post_init__(self):
        if not 0.0 <= self.medium <= self.high <= 1.0:
            raise ValueError("need 0 <= medium <= high <= 1")


# --- learning tasks -------------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    name: str
    target: str
    features: tuple[str, ...]
    strata: tuple[str, ...]


STAGE_TASK = Task(
    "stage_classification",
    "evolution_stage",
    ROUTER_FEATURES,
    ("evolution_stage", "spec_class"),
)
CLASS_TASK = Task(
    "spectral_class_classification",
    "spec_class",
    ROUTER_FEATURES,
    ("spec_class", "evolution_stage"),
)
SUBCLASS_TASK = Task(
    "spectral_subclass_classification",
    "spec_subclass",
    ROUTER_FEATURES,
    ("spec_subclass",),
)
HOST_TASK = Task(
    "host_field_classification",
    "host_label",
    ROUTER_FEATURES,
    ("host_label", "spec_class", "evolution_stage"),
)
COARSE_TASK = Task(
    "gaia_id_coarse_classification",
    "spec_class",
    COARSE_FEATURES,
    ("spec_class", "evolution_stage"),
)
REFINEMENT_TASK = Task(
    "gaia_mk_refinement_classification",
    "spec_subclass",
    REFINEMENT_FEATURES,
    ("spec_subclass",),
)
OOD_TASK = Task(
    "gaia_id_ood_classification",
    "domain_target",
    OOD_FEATURES,
    ("domain_target",),
)


def family_task(spectral_class: str) -> Task:
    family = require_family(spectral_class)
    return Task(
        f"gaia_mk_refinement_{family.lower()}_classification",
        "spectral_subclass",
        FAMILY_FEATURES,
        ("spectral_subclass",),
    )


def require_family(spectral_class: str) -> str:
    family = str(spectral_class).strip().upper()
    if family not in REFINED_CLASSES:
        raise ValueError(
            f"no refinement family {spectral_class!r}; choose from {', '.join(REFINED_CLASSES)}"
        )
    return family


@dataclass(frozen=True)
class Protocol:
    """Benchmark protocol: one stratified split plus k-fold validation."""

    test_share: float = 0.30
    folds: int = 10
    seed: int = 42

    def __post_init__(self):
        if not 0.0 < self.test_share < 1.0:
            raise ValueError("test_share must lie strictly between 0 and 1")
        if self.folds < 2:
            raise ValueError("folds must be at least 2")
