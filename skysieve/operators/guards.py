"""Contract checks. Column checks need no job; value checks return small violation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.labels import normalize_stage, normalize_subclass

SAMPLE = 5


def require_columns(df: DataFrame, names, what: str) -> None:
    have = set(df.columns)
    missing = [n for n in dict.fromkeys(names) if n not in have]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def require_relations(frames: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> None:
    """Check several input relations before any ETL work starts; report all gaps at once."""
    gaps = {
        name: [c for c in needed if c not in set(df.columns)] for name, (df, needed) in frames.items()
    }
    gaps = {name: cols for name, cols in gaps.items() if cols}
    if gaps:
        text = "; ".join(f"{name}: {', '.join(cols)}" for name, cols in sorted(gaps.items()))
        raise ValueError(f"relations are missing required columns: {text}")


def duplicate_ids(df: DataFrame, key: str = "source_id") -> DataFrame:
    """Ids (as text) that occur more than once, with their row counts."""
    return (
        df.groupBy(F.col(key).cast("string").alias(key))
        .agg(F.count("*").alias("n_rows"))
        .where("n_rows > 1")
    )


def require_unique(df: DataFrame, what: str, key: str = "source_id") -> DataFrame:
    """Raise with up to five sample ids when an id repeats; else hand the frame back."""
    bad = [r[0] for r in duplicate_ids(df, key).orderBy(key).limit(SAMPLE).collect()]
    if bad:
        raise ValueError(f"{what} contains duplicate {key} values. Sample ids: {', '.join(bad)}")
    return df


def label_violations(df: DataFrame) -> DataFrame:
    """Distinct unsupported label values as (column_name, bad_value), one pass over the frame."""
    rules = {
        "spec_class": ~F.col("spec_class").isin(*C.SPECTRAL_CLASSES),
        "evolution_stage": ~normalize_stage(F.col("evolution_stage")).isin(*C.STAGES),
    }
    if "spec_subclass" in df.columns:
        rules["spec_subclass"] = ~normalize_subclass(F.col("spec_subclass")).rlike(C.SUBCLASS_PATTERN)
    return _violations(df, rules)


def domain_violations(df: DataFrame) -> DataFrame:
    return _violations(df, {"domain_target": ~F.col("domain_target").isin(*C.DOMAIN_TARGETS)})


def family_violations(df: DataFrame, family: str) -> DataFrame:
    return _violations(df, {"spectral_class": F.col("spectral_class") != family})


def _violations(df: DataFrame, rules) -> DataFrame:
    found = F.array(
        *[
            F.when(
                broken,
                F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("bad_value")),
            )
            for name, broken in rules.items()
        ]
    )
    return (
        df.select(F.explode(F.array_compact(found)).alias("v"))
        .select("v.column_name", "v.bad_value")
        .distinct()
    )


def require_no_violations(violations: DataFrame, what: str) -> None:
    rows = violations.orderBy("column_name", "bad_value").limit(SAMPLE).collect()
    if rows:
        name = rows[0].column_name
        sample = ", ".join(r.bad_value for r in rows if r.column_name == name)
        raise ValueError(f"{what} contains unsupported {name} values: {sample}")
