"""Star-shaped views over the driver tables.

The driver tables hold no stars, so the registered queries read `orders`,
`lineitem` and `events` through these column formulas. Only integer arithmetic,
casts and CASE are used; Spark and DuckDB evaluate the same text to the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "o_orderkey"

_CLASSES = "OBAFGKM"


def _every(n: int, expr: str) -> str:
    """`expr`, missing for every n-th key."""
    return f"CASE WHEN {K} % {n} = 0 THEN NULL ELSE {expr} END"


def _score(i: int) -> str:
    """Score of class i; the own class of a star gets a bonus."""
    return f"(CASE WHEN {K} % 7 = {i} THEN 250 ELSE 0 END + ({K} * {7 * i + 11}) % 700) / 1E3"


LUMINOSITY = (
    f"CASE {K} % 12 WHEN 0 THEN 'V' WHEN 1 THEN 'V' WHEN 2 THEN 'V' WHEN 3 THEN 'V' "
    "WHEN 4 THEN 'III' WHEN 5 THEN 'IV' WHEN 6 THEN 'II' WHEN 7 THEN 'Ib' "
    "WHEN 8 THEN 'Iab' WHEN 9 THEN 'Ia' WHEN 10 THEN 'VI' ELSE NULL END"
)
_LETTER = f"substr('{_CLASSES}', CAST({K} % 7 + 1 AS INT), 1)"
_DIGIT = f"CAST({K} % 10 AS STRING)"
RAW_SPTYPE = (
    f"CASE WHEN {K} % 67 = 0 THEN '  ' WHEN {K} % 71 = 0 THEN 'OB-' WHEN {K} % 73 = 0 THEN 'B9.5V' "
    f"WHEN {K} % 79 = 0 THEN 'WD' WHEN {K} % 83 = 0 THEN 'O9.5/B0IV/V' WHEN {K} % 89 = 0 THEN 'k7  iii' "
    f"WHEN {K} % 97 = 0 THEN 'G' WHEN {K} % 101 = 0 THEN 'F5 Ia+ e' "
    f"ELSE {_LETTER} || {_DIGIT} || coalesce({LUMINOSITY}, '') || "
    f"CASE WHEN {K} % 15 = 0 THEN 'e' ELSE '' END END"
)

STAR_COLUMNS: dict[str, str] = {
    "source_id": K,
    "random_index": f"({K} * 7919) % 1000003",
    "ra": f"(({K} * 48271) % 3600000) / 1E4",
    "dec": f"(({K} * 69621) % 1780000) / 1E4 - 89E0",
    "teff_gspphot": _every(23, f"CAST(2600 + ({K} * 37) % 29000 AS DOUBLE)"),
    "logg_gspphot": _every(29, f"(({K} * 13) % 500) / 1E2"),
    "mh_gspphot": _every(37, f"(({K} * 5) % 300) / 1E2 - 2E0"),
    "bp_rp": _every(41, f"(({K} * 23) % 400) / 1E2 - 5E-1"),
    "parallax": f"(({K} * 17) % 2500) / 1E2",
    "parallax_over_error": _every(31, f"(({K} * 11) % 3000) / 1E2"),
    "ruwe": f"(80 + ({K} * 7) % 120) / 1E2",
    "phot_g_mean_mag": f"(800 + ({K} * 19) % 1000) / 1E2",
    "radius_flame": _every(13, f"(({K} * 3) % 400) / 1E2"),
    "radius_gspphot": _every(17, f"(({K} * 3 + 7) % 420) / 1E2"),
    "lum_flame": _every(19, f"(({K} * 29) % 5000) / 1E2"),
    "evolstage_flame": _every(11, f"CAST(100 + ({K} * 43) % 1300 AS DOUBLE)"),
    "non_single_star": f"CASE WHEN {K} % 47 = 0 THEN 1 ELSE 0 END",
    "classprob_dsc_combmod_star": _every(53, f"1E0 - (({K} * 31) % 600) / 1E3"),
    "validation_factor": _every(5, f"(({K} * 3) % 100) / 1E2"),
    "spec_class": _LETTER,
    "spec_subclass": f"CASE WHEN {K} % 59 = 0 THEN NULL WHEN {K} % 61 = 0 THEN 'x?' ELSE {_LETTER} || {_DIGIT} END",
    "spectral_class": _LETTER,
    "spectral_subclass": _every(61, f"CAST({K} % 10 AS INT)"),
    "luminosity_class": LUMINOSITY,
    "evolution_stage": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'subgiant' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'giant' ELSE 'dwarf' END",
    "is_evolved": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "host_similarity_score": _every(43, "o_totalprice / 5E5"),
    "ood_probability": f"(({K} * 97) % 1000) / 1E3",
    **{f"p_{c}": _score(i) for i, c in enumerate(_CLASSES)},
    "refinement_label": _every(7, f"{_LETTER} || {_DIGIT}"),
    "refinement_probability": f"(({K} * 71) % 1000) / 1E3",
    "raw_sptype": RAW_SPTYPE,
    "esphs_class_letter": f"CASE {K} % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'U' ELSE NULL END",
    "flags_esphs": f"CAST(CASE WHEN {K} % 6 = 0 THEN 999 WHEN {K} % 6 = 1 THEN NULL ELSE {K} % 6 END AS INT)",
    "teff_esphs": _every(9, f"CAST(9000 + ({K} * 41) % 30000 AS DOUBLE)"),
    "spectraltype_esphs": f"CASE {K} % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B' WHEN 2 THEN 'A' ELSE NULL END",
    "in_gold_sample_oba_stars": f"{K} % 4 = 0",
}

CLASS_PROBABILITIES = {c: f"p_{c}" for c in _CLASSES}


def star_sql(names=None, table: str = "orders") -> str:
    """SELECT text of the star view, for the DuckDB twin."""
    cols = STAR_COLUMNS if names is None else {n: STAR_COLUMNS[n] for n in names}
    body = ", ".join(f"{expr} AS {name}" for name, expr in cols.items())
    return f"SELECT {body} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_view(orders: DataFrame, *names: str, keep=()) -> DataFrame:
    """Star columns of `orders` rows, and the columns to `keep` as they are."""
    wanted = names or tuple(STAR_COLUMNS)
    return orders.select(*[F.expr(STAR_COLUMNS[n]).alias(n) for n in wanted], *keep)


def stars(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The star view over `orders`; Catalyst prunes the formulas a query does not use."""
    return star_view(table(spark, sf_dir, "orders"), *names)


# candidate pairs of a sky match: separation in degrees, repeats of a pair still in
CANDIDATE_COLUMNS = {
    "external_row_id": "l_orderkey",
    "source_id": "(l_partkey * 31 + l_suppkey * 7) % 15000",
    "SEPARATION": "l_extendedprice / 1E9",
}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *[F.expr(e).alias(n) for n, e in CANDIDATE_COLUMNS.items()]
    )


def candidate_sql() -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in CANDIDATE_COLUMNS.items())
    return f"SELECT {body} FROM lineitem"


# rows of an out-of-domain reference: a star may belong to several groups
MEMBERSHIP_COLUMNS = {
    "source_id": "user_id",
    "domain_target": "' OOD '",
    "ood_group": "event_type",
    "ood_membership_count": "CAST(1 + event_id % 3 AS DOUBLE)",
    "has_multi_ood_membership": "event_id % 2 = 0",
    "random_index": "event_id",
    "teff_gspphot": "CAST(3000 + event_id % 9000 AS DOUBLE)",
    "logg_gspphot": "(event_id % 500) / 1E2",
    "mh_gspphot": "(event_id % 300) / 1E2 - 2E0",
    "bp_rp": "(event_id % 400) / 1E2",
    "parallax": "(event_id % 2500) / 1E2",
    "parallax_over_error": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 3000) / 1E2 END",
    "ruwe": "(80 + event_id % 120) / 1E2",
    "phot_g_mean_mag": "(800 + event_id % 1000) / 1E2",
    "selector_score_1": "value",
    "selector_score_2": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 2E0 END",
}


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *[F.expr(e).alias(n) for n, e in MEMBERSHIP_COLUMNS.items()]
    )


def membership_sql() -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in MEMBERSHIP_COLUMNS.items())
    return f"SELECT {body} FROM events"
