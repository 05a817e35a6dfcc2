"""Scans of star tables: contract projection, row filters, optional limited order.

A source is a DataFrame, a catalog table name or a Parquet path. Filters and the
column list are plain expressions, so they reach the file scan by themselves; rows
are ordered only where a limit needs an order.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysieve import contracts as C
from skysieve.functions.numeric import drop_nans
from skysieve.operators.guards import require_columns
from skysieve.operators.layers import all_present


def open_relation(spark: SparkSession, source) -> DataFrame:
    if isinstance(source, DataFrame):
        df = source
    elif "/" in source:
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    return drop_nans(df)


# columns that the table contracts use as numbers, whole numbers and flags; every other name is text
_NUMBERS = frozenset(
    C.ordered_union(
        C.ROUTER_FEATURES, C.COARSE_FEATURES, C.OOD_FEATURES, C.FAMILY_FEATURES, C.QUALITY_FEATURES,
        C.OBSERVABILITY_FEATURES,
        ("classprob_dsc_combmod_star", "ra_gaia", "dec_gaia", "dist_arcsec", "selector_score_1", "selector_score_2"),
    )
)
_NUMBER_ENDINGS = ("_probability", "_score", "_margin", "_confidence", "_arcsec")
_WHOLE = frozenset(("random_index", "external_row_id", "ood_membership_count", "reference_membership_count"))
_FLAGS = ("has_", "is_", "in_")


def csv_kind(name: str) -> str:
    """Type of a CSV column by its name; ids are text until a contract asks for a number."""
    if name in _WHOLE:
        return "bigint"
    if name in _NUMBERS or name.endswith(_NUMBER_ENDINGS):
        return "double"
    return "boolean" if name.startswith(_FLAGS) else "string"


def _typed(name: str, kind: str) -> Column:
    """The cell as its kind; an empty cell is NULL, any other that does not convert is an error."""
    cell = F.col(f"`{name}`")
    if kind == "string":
        return cell
    text = F.lower(F.trim(cell))
    if kind == "boolean":
        value = F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
    else:
        value = cell.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"column {name} is no {kind}: "), cell)).cast(kind)
    blank = cell.isNull() | text.isin("", "nan", "null", "none")
    return F.when(blank, F.lit(None).cast(kind)).when(value.isNotNull(), value).otherwise(bad)


def read_star_csv(
    spark: SparkSession, path: str, kinds: dict[str, str] | None = None, *, quote: str = '"', escape: str = '"', multi_line: bool = False
) -> DataFrame:
    """CSV with a header line; columns typed by name, or as `kinds` says.

    Every file's header is held against the first one, so files with another column order are an error.
    """
    header = next(csv.reader([spark.read.text(path).first()["value"]], quotechar=quote))
    text = T.StructType([T.StructField(n, T.StringType()) for n in header])
    options = {"header": True, "enforceSchema": False, "quote": quote, "escape": escape, "multiLine": multi_line}
    rows = spark.read.schema(text).options(**options).csv(path)
    wanted = kinds or {}
    return drop_nans(rows.select(*[_typed(n, wanted.get(n, csv_kind(n))).alias(n) for n in header]))


def project(df: DataFrame, contract: C.TableContract) -> DataFrame:
    """Required columns, then the optional ones that exist (P01); gaps raise before any job."""
    require_columns(df, contract.required, contract.name)
    return df.select(*contract.columns(df.columns))


def _limited(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    if limit is None:
        return df
    have = set(df.columns)
    return df.orderBy(*[c for c in order if c in have]).limit(limit)


def _known_class(column: str = "spec_class"):
    return F.col(column).isin(*C.SPECTRAL_CLASSES)


def router_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.ROUTER_TRAINING).where(
        all_present(("source_id", "teff_gspphot", "logg_gspphot", "radius_gspphot"))
        & _known_class()
        & F.col("evolution_stage").isin(*C.STAGES)
    )
    return _limited(rows, limit, "random_index", "source_id")


def host_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.HOST_TRAINING).where(
        all_present(("source_id", "teff_gspphot", "logg_gspphot", "radius_flame"))
        & _known_class()
        & F.col("evolution_stage").isin(*C.SOURCE_STAGES)
    )
    return _limited(rows, limit, "source_id")


def coarse_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.COARSE_TRAINING).where(
        all_present(("source_id", *C.CORE_FEATURES, "is_evolved")) & _known_class()
    )
    return _limited(rows, limit, "random_index", "source_id")


def ood_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.OOD_TRAINING).where(
        all_present(("source_id", *C.CORE_FEATURES)) & F.col("domain_target").isin(*C.DOMAIN_TARGETS)
    )
    return _limited(rows, limit, "random_index", "domain_target", "source_id")


def refinement_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.REFINEMENT_TRAINING).where(
        all_present(("source_id", "spectral_subclass", *C.CORE_FEATURES, "radius_flame"))
        & _known_class("spectral_class")
    )
    return _limited(rows, limit, "random_index", "source_id")


def family_rows(df: DataFrame, spectral_class: str, limit: int | None = None) -> DataFrame:
    """One family; on a table partitioned by `spectral_class` this prunes to one partition."""
    rows = project(df, C.FAMILY_TRAINING).where(
        (F.col("spectral_class") == C.require_family(spectral_class))
        & all_present(("source_id", "spectral_subclass"))
    )
    return _limited(rows, limit, "random_index", "source_id")


def scoring_rows(df: DataFrame, features, limit: int | None = None) -> DataFrame:
    """Rows a model can score: a gap in any feature drops the row."""
    contract = C.TableContract(
        "model scoring source", ("source_id", *features), C.SCORING_OPTIONAL_COLUMNS
    )
    rows = project(df, contract).where(all_present(("source_id", *features)))
    return _limited(rows, limit, "random_index", "source_id")


def stand_in(feature: str, available) -> str | None:
    """Column that supplies a feature: itself, else its first present stand-in."""
    return next(
        (c for c in (feature, *C.FEATURE_STAND_INS.get(feature, ())) if c in available), None
    )


def alias_features(df: DataFrame, features) -> DataFrame:
    """Add absent features from their stand-ins, by column presence and not per row."""
    have = set(df.columns)
    missing = {f: stand_in(f, have) for f in features if f not in have}
    return df.withColumns({f: F.col(src) for f, src in missing.items() if src})


def decision_rows(df: DataFrame, features, limit: int | None = None) -> DataFrame:
    """Decision input: id and quality state present, features may be missing."""
    have = set(df.columns)
    sources = [stand_in(f, have) or f for f in features]
    contract = C.TableContract(
        "final decision source", ("source_id", "quality_state", *sources), C.DECISION_OPTIONAL_COLUMNS
    )
    rows = project(df, contract).where(all_present(("source_id", "quality_state")))
    return alias_features(_limited(rows, limit, "random_index", "source_id"), features)


def gate_audit_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = project(df, C.GATE_AUDIT).where(all_present(("source_id", "quality_state", "ood_state")))
    return _limited(rows, limit, "random_index", "quality_state", "source_id")


def hot_boundary_rows(
    df: DataFrame, quality_state: str = "pass", min_teff: float = C.HOT_TEFF_K, limit: int | None = None
) -> DataFrame:
    rows = df.where(
        F.col("source_id").isNotNull()
        & F.col("spectral_class").isin("O", "B")
        & (F.col("quality_state") == quality_state)
        & (F.col("teff_gspphot") >= min_teff)
    )
    return _limited(rows, limit, "random_index", "source_id")


def o_review_rows(df: DataFrame, quality_state: str | None = None, limit: int | None = None) -> DataFrame:
    rows = df.where(F.col("source_id").isNotNull() & (F.col("spectral_class") == "O"))
    if quality_state is not None:
        rows = rows.where(F.col("quality_state") == quality_state)
    return _limited(rows, limit, "random_index", "source_id")


def uploaded_csv_report(df: DataFrame, required, numeric, states) -> DataFrame:
    """Problems of an external CSV read as text: one pass, one row per rule and column."""
    require_columns(df, required, "external CSV")

    def blank(c):
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    checks = {f"blank:{c}": blank(c) for c in required}
    checks |= {f"not_numeric:{c}": ~blank(c) & F.col(c).try_cast("double").isNull() for c in numeric}
    state = F.lower(F.trim(F.col("quality_state")))
    checks["bad_state:quality_state"] = F.coalesce(~state.isin(*states), F.lit(True))
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    return (
        counts.unpivot([], list(checks), "check", "n_rows")
        .select(
            F.split_part("check", F.lit(":"), F.lit(1)).alias("rule"),
            F.split_part("check", F.lit(":"), F.lit(2)).alias("column_name"),
            "n_rows",
        )
    )
