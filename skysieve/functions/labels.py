"""Spectral label text as column expressions: normalising, parsing, staging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions.numeric import clean_text

# --- fixed values: patterns and code spellings ----------------------------------------

OB_BOUNDARY = "^(OB|O/B|O[0-9](\\.[0-9]+)?/B)"
# longest spelling first where one code is a prefix of another
LUMINOSITY_PREFIX = "^(IA\\+|IAB|IA|IB|III|VII|VI|IV|II|I|V|0)"
# class letter, digit with or without fraction, luminosity class, rest
LABEL = "^([OBAFGKM])([0-9](?:\\.[0-9]+)?)?" + LUMINOSITY_PREFIX[1:] + "?(.*)$"


def normalize_label(c: Column) -> Column:
    """Trim, collapse inner blanks to one, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, "\\s+", " ")))


def _compact(c: Column) -> Column:
    return F.regexp_replace(normalize_label(c), " ", "")


def _found(text: Column) -> Column:
    """regexp_extract yields '' when nothing matched."""
    return F.nullif(text, F.lit(""))


def is_ob_boundary(compact: Column) -> Column:
    return compact.rlike(OB_BOUNDARY)


def _mixed_case(code: Column) -> Column:
    """IA+, IAB, IA, IB are written Ia+, Iab, Ia, Ib; the other codes hold no A or B."""
    return F.translate(code, "AB", "ab")


def luminosity_code(rest: Column) -> Column:
    """Luminosity class at the start of what follows class and digit, or NULL."""
    return _found(_mixed_case(F.regexp_extract(rest, LUMINOSITY_PREFIX, 1)))


def luminosity_rest(rest: Column) -> Column:
    """What remains after the luminosity class; NULL when nothing does."""
    return _found(F.trim(F.regexp_replace(rest, LUMINOSITY_PREFIX, "")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once per row; branches that name an expression would work it out again."""
    return F.transform(F.array(value), body)[0]


def parse_label(c: Column) -> Column:
    """Struct with class, digit, luminosity, suffix, status and note of one label.

    The branches are tried in order: empty, O/B boundary, no class letter,
    fractional digit, no digit, whole digit. Each pattern is matched once per label.
    """

    def cut(text: Column) -> Column:
        compact = text["compact"]
        groups = {n: F.regexp_extract(compact, LABEL, i + 1).alias(n) for i, n in enumerate(("first", "digits", "luminosity", "suffix"))}
        return F.struct(
            text["normalized"].alias("normalized"), compact.alias("compact"), is_ob_boundary(compact).alias("boundary"), *groups.values()
        )

    def compacted(normalized: Column) -> Column:
        return F.struct(normalized.alias("normalized"), F.regexp_replace(normalized, " ", "").alias("compact"))

    label = F.coalesce(normalize_label(c), F.lit(""))
    return _let(label, lambda n: _let(compacted(n), lambda text: _let(cut(text), _parsed)))


def _parsed(cells: Column) -> Column:
    compact, boundary = cells["compact"], cells["boundary"]
    first, digits, luminosity, suffix = cells["first"], cells["digits"], cells["luminosity"], cells["suffix"]
    empty = compact == ""
    read = ~boundary & (first != "")

    note = (
        F.when(empty, "empty_label")
        .when(boundary, "ambiguous_ob_boundary_label")
        .when(first == "", "missing_supported_spectral_class")
        .when(F.length(digits) > 1, "fractional_subclass_requires_separate_policy")
        .when(digits == "", "missing_integer_subclass")
        .when(luminosity == "", "missing_luminosity_class")
    )
    return F.struct(
        cells["normalized"].alias("normalized_value"),
        F.when(boundary, "OB").when(first != "", first).alias("spectral_class"),
        F.when(read & (F.length(digits) == 1), digits.try_cast("int")).alias("spectral_subclass"),
        F.when(read & (luminosity != ""), _mixed_case(luminosity)).alias("luminosity_class"),
        F.when(read, _found(suffix)).otherwise(_found(compact)).alias("peculiarity_suffix"),
        F.when(empty, "empty")
        .when(boundary, "partial")
        .when(first == "", "unsupported")
        .when((F.length(digits) == 1) & (luminosity != ""), "parsed")
        .otherwise("partial")
        .alias("parse_status"),
        note.alias("parse_note"),
    )


def stage_of_luminosity(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.isin(*C.DWARF_LUMINOSITY_CODES), "dwarf").when(
        code.isin(*C.EVOLVED_LUMINOSITY_CODES), "evolved"
    )


def stage_of_flag(is_evolved: Column) -> Column:
    return F.when(is_evolved, "evolved").otherwise("dwarf")


def normalize_class(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def normalize_stage(c: Column) -> Column:
    text = F.lower(F.trim(c))
    out = F.when(text.isNull(), None)
    for source, target in C.STAGE_ALIASES.items():
        out = out.when(text == source, target)
    return out.otherwise(text)


def normalize_subclass(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def canonical_subclass(c: Column) -> Column:
    """Keep class+digit labels, turn anything else into missing."""
    return F.when(normalize_subclass(c).rlike(C.SUBCLASS_PATTERN), c)


def full_subclass(spec_class: Column, subclass: Column) -> Column:
    """A bare digit gets its class in front; other text is only normalised."""
    text = F.nullif(normalize_subclass(subclass), F.lit(""))
    return F.when(text.rlike("^[0-9]$"), F.concat(normalize_class(spec_class), text)).otherwise(text)


def family_digit(subclass: Column, family: str) -> Column:
    """One digit 0-9 from an int, a whole float, digit text or class+digit of the family."""
    text = F.upper(F.trim(subclass.cast("string")))
    return _found(F.regexp_extract(text, f"^(?:{family})?([0-9])(?:\\.0)?$", 1))


def family_label(label: Column, family: str) -> Column:
    """Predicted label of a family model: bare digits get the family letter in front."""
    text = F.upper(clean_text(label))
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit(family), text)).otherwise(text)
