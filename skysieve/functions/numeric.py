"""Missing values, number clean-up and small score building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEUTRAL_SCORE = 0.5


def no_nan(c: Column) -> Column:
    """NaN counts as missing everywhere; Spark would order it above all numbers."""
    return F.nanvl(c, F.lit(None).cast("double"))


def drop_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in all float columns, once, right after a scan."""
    fixes = {
        f.name: no_nan(F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def to_number(c: Column) -> Column:
    """Lenient cast: text that is no number becomes NULL, NaN too."""
    return no_nan(c.try_cast("double"))


def coerce_numbers(df: DataFrame, names) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({n: to_number(F.col(n)) for n in names if n in have})


def strict_number(df: DataFrame, name: str) -> Column:
    """Score input: absent column or missing value stays missing, bad text fails the job."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return no_nan(F.col(name).cast("double"))


def clean_text(c: Column) -> Column:
    """Trimmed text; blank counts as missing."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clip01(c: Column) -> Column:
    """Clamp a value that is known to be present."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clamp01(c: Column) -> Column:
    # greatest/least skip NULL, so a missing score has to stay missing explicitly
    return F.when(c.isNotNull(), clip01(c))


def linear_score(
    c: Column, low: float, high: float, *, rising: bool = True, missing: float = NEUTRAL_SCORE
) -> Column:
    """Position of `c` between low and high, clamped; neutral when missing."""
    if high <= low:
        raise ValueError("linear score needs high > low")
    share = (c - F.lit(float(low))) / F.lit(float(high) - float(low))
    score = share if rising else F.lit(1.0) - share
    return F.when(c.isNotNull(), clip01(score)).otherwise(float(missing))


def argmax_label(labels, probabilities) -> Column:
    """First label (in the given, sorted order) that reaches the top probability."""
    ranked = F.array(
        *[
            F.struct(p.alias("p"), F.lit(-i).alias("order"), F.lit(x).alias("label"))
            for i, (x, p) in enumerate(zip(labels, probabilities, strict=True))
        ]
    )
    best = F.array_max(ranked)
    return F.when(best["p"].isNotNull(), best["label"])


def top_margin(probabilities) -> Column:
    """Largest probability minus the second largest (0 for one class)."""
    if len(probabilities) == 1:
        return probabilities[0]
    first_two = F.slice(F.sort_array(F.array(*probabilities), asc=False), 1, 2)
    return F.aggregate(F.reverse(first_two), F.lit(0.0), lambda acc, p: p - acc)
