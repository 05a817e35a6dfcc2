"""Registered queries: catalogue scan, label parsing, catalogue exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.functions import labels as LB
from skysieve.functions.numeric import clean_text
from skysieve.plans import stars as st
from skysieve.plans.registry import query
from skysieve.plans.twins import VIEWS, twin
from skysieve.session import scratch_path
from skysieve.sources import catalogue as cat

K = st.K


def _two(expr: str) -> str:
    return f"lpad(CAST({expr} AS STRING), 2, '0')"


# one 141-byte record per order, built in the layout of the byte table
LINE = (
    f"concat(rpad(concat('REF', CAST({K} AS STRING)), 21, ' '), "
    f"rpad(CASE WHEN {K} % 41 = 0 THEN '' ELSE concat('HD ', CAST({K} AS STRING)) END, 28, ' '), "
    f"CASE WHEN {K} % 19 = 0 THEN '  ' ELSE {_two(f'{K} % 24')} END, ' ', {_two(f'{K} % 60')}, ' ', "
    f"{_two(f'(({K} * 7) % 6000) div 100')}, '.', {_two(f'({K} * 7) % 100')}, ' ', "
    f"CASE WHEN {K} % 2 = 0 THEN '-' ELSE '+' END, {_two(f'{K} % 90')}, ' ', {_two(f'({K} * 3) % 60')}, ' ', "
    f"{_two(f'(({K} * 11) % 600) div 10')}, '.', CAST(({K} * 11) % 10 AS STRING), ' T ', "
    f"CASE WHEN {K} % 8 = 0 THEN '     ' ELSE concat({_two(f'({K} % 2000) div 100')}, '.', {_two(f'{K} % 100')}) END, "
    f"'V  ', rpad({st.RAW_SPTYPE}, 27, ' '), "
    f"rpad(CASE WHEN {K} % 3 = 0 THEN '' ELSE concat('note ', CAST({K} % 100 AS STRING)) END, 31, ' '))"
)

VIEWS["catalog"] = f"""
SELECT row_number() OVER (ORDER BY k) - 1 AS external_row_id, 'bmk' AS external_catalog_name, CASE WHEN k % 41 <> 0 THEN 'HD ' || k END AS external_object_id,
  CASE WHEN k % 19 <> 0 THEN 15E0 * (k % 24 + (k % 60) / 60E0 + (((k * 7) % 6000) / 1E2) / 3600E0) END AS ra_deg,
  CASE WHEN k % 19 <> 0 THEN CASE WHEN k % 2 = 0 THEN -1E0 ELSE 1E0 END
    * (k % 90 + ((k * 3) % 60) / 60E0 + (((k * 11) % 600) / 1E1) / 3600E0) END AS dec_deg,
  nullif(trim(sp), '') AS raw_sptype, CASE WHEN k % 8 <> 0 THEN (k % 2000) / 1E2 END AS raw_magnitude,
  'REF' || k AS raw_source_bibcode, CASE WHEN k % 3 <> 0 THEN 'note ' || (k % 100) END AS raw_notes
FROM (SELECT {K} AS k, {st.RAW_SPTYPE} AS sp FROM orders)"""

# label parser in DuckDB: same rules, own regular expressions
VIEWS["parsed"] = """
SELECT *, CASE WHEN norm = '' OR ob OR cls IS NULL THEN NULL WHEN NOT frac AND regexp_matches(t, '^.[0-9]') THEN CAST(t[2] AS INT) END AS digit,
  CASE WHEN norm = '' OR ob OR cls IS NULL THEN NULL
    WHEN starts_with(rest, 'IA+') THEN 'Ia+' WHEN starts_with(rest, 'IAB') THEN 'Iab' WHEN starts_with(rest, 'IA') THEN 'Ia'
    WHEN starts_with(rest, 'IB') THEN 'Ib' WHEN starts_with(rest, 'III') THEN 'III' WHEN starts_with(rest, 'VII') THEN 'VII'
    WHEN starts_with(rest, 'VI') THEN 'VI' WHEN starts_with(rest, 'IV') THEN 'IV' WHEN starts_with(rest, 'II') THEN 'II'
    WHEN starts_with(rest, 'I') THEN 'I' WHEN starts_with(rest, 'V') THEN 'V' WHEN starts_with(rest, '0') THEN '0' END AS lum
FROM (SELECT *, CASE WHEN frac THEN regexp_replace(t, '^.[0-9][.][0-9]+', '') WHEN regexp_matches(t, '^.[0-9]') THEN t[3:] ELSE t[2:] END AS rest
FROM (SELECT *, regexp_matches(t, '^(OB|O/B|O[0-9]([.][0-9]+)?/B)') AS ob, regexp_matches(t, '^[OBAFGKM][0-9][.][0-9]') AS frac,
  CASE WHEN regexp_matches(t, '^[OBAFGKM]') THEN t[1] END AS cls
FROM (SELECT *, replace(norm, ' ', '') AS t FROM (SELECT source_id, raw_sptype,
  upper(trim(regexp_replace(raw_sptype, '\\s+', ' ', 'g'))) AS norm FROM stars))))"""
VIEWS["parse_result"] = """
SELECT source_id, raw_sptype, norm AS normalized_value, CASE WHEN norm <> '' AND ob THEN 'OB' ELSE cls END AS spectral_class, digit AS spectral_subclass,
  lum AS luminosity_class,
  CASE WHEN norm = '' THEN NULL WHEN ob OR cls IS NULL THEN t WHEN lum IS NULL THEN nullif(rest, '') ELSE nullif(rest[len(lum) + 1:], '') END
    AS peculiarity_suffix,
  CASE WHEN norm = '' THEN 'empty' WHEN ob THEN 'partial' WHEN cls IS NULL THEN 'unsupported'
    WHEN digit IS NOT NULL AND lum IS NOT NULL THEN 'parsed' ELSE 'partial' END AS parse_status,
  CASE WHEN norm = '' THEN 'empty_label' WHEN ob THEN 'ambiguous_ob_boundary_label' WHEN cls IS NULL THEN 'missing_supported_spectral_class'
    WHEN frac THEN 'fractional_subclass_requires_separate_policy' WHEN digit IS NULL THEN 'missing_integer_subclass'
    WHEN lum IS NULL THEN 'missing_luminosity_class' END AS parse_note
FROM parsed"""
VIEWS["classified"] = """
SELECT c.*, p.spectral_class, p.spectral_subclass, p.luminosity_class, p.peculiarity_suffix, p.parse_status, p.parse_note,
  CASE WHEN ra_deg IS NULL THEN 'missing_coordinates' WHEN c.raw_sptype IS NULL THEN 'missing_raw_sptype'
    WHEN p.spectral_class IS NULL OR p.spectral_class = 'OB' THEN 'unsupported_spectral_prefix' ELSE 'filtered' END AS outcome
FROM catalog c JOIN parse_result p ON 'REF' || p.source_id = c.raw_source_bibcode"""
VIEWS["cat_filtered"] = f"""
SELECT {', '.join(C.RAW_COLUMNS)}, spectral_class AS spectral_prefix, spectral_class, spectral_subclass, luminosity_class, parse_status, parse_note,
  true AS has_supported_prefix, true AS has_coordinates, true AS has_raw_sptype, true AS ready_for_gaia_crossmatch
FROM classified WHERE outcome = 'filtered'"""
VIEWS["cat_rejected"] = f"""
SELECT {', '.join(C.RAW_COLUMNS)}, CASE WHEN outcome = 'unsupported_spectral_prefix' THEN spectral_class END AS spectral_prefix,
  outcome AS reject_reason FROM classified WHERE outcome <> 'filtered'"""


_TEXT: dict[tuple[str, str], str] = {}


def catalogue_text(spark, sf):
    """The orders table as a fixed-width text catalogue, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TEXT:
        path = scratch_path(spark, "catalogue-text")
        orders = st.table(spark, sf, "orders").select(F.col(K).alias("k"), F.expr(LINE).alias("value"))
        orders.orderBy("k").select("value").write.text(path)
        _TEXT[key] = path
    return _TEXT[key]


def scan(spark, sf):
    return cat.read_catalogue(spark, catalogue_text(spark, sf))


def records(spark, sf):
    return cat.base_records(scan(spark, sf))


def classified(spark, sf):
    return cat.classify(records(spark, sf))


def filtered(spark, sf):
    return cat.filtered_frame(classified(spark, sf))


@query("s01_fixed_width_scan", twin("SELECT * FROM catalog"))
def s01(spark, sf):
    return records(spark, sf)


@query(
    "p18_icrs_degrees",
    twin("SELECT external_row_id, ra_deg, dec_deg FROM catalog"),
)
def p18(spark, sf):
    ra, dec = cat.icrs_degrees()
    return scan(spark, sf).select(
        "external_row_id", ra.alias("ra_deg"), dec.alias("dec_deg")
    )


@query(
    "p19_clean_cells",
    twin(
        "SELECT external_row_id, external_object_id, raw_sptype, raw_magnitude, raw_notes FROM catalog"
    ),
)
def p19(spark, sf):
    return records(spark, sf).select(
        "external_row_id", "external_object_id", "raw_sptype", "raw_magnitude", "raw_notes"
    )


@query(
    "p20_row_numbers",
    twin(
        "SELECT row_number() OVER (ORDER BY k) - 1 AS external_row_id, 'REF' || k AS bibcode "
        "FROM (SELECT o_orderkey AS k FROM orders)"
    ),
)
def p20(spark, sf):
    return scan(spark, sf).select("external_row_id", F.col("Bibcode").alias("bibcode"))


@query("l01_normalize_label", twin("SELECT source_id, norm AS label FROM parsed"))
def l01(spark, sf):
    return st.stars(spark, sf, "source_id", "raw_sptype").select(
        "source_id", LB.normalize_label(F.col("raw_sptype")).alias("label")
    )


PARSE_OUT = "source_id, normalized_value, spectral_class, spectral_subclass, luminosity_class, peculiarity_suffix, parse_status, parse_note"


@query("l02_parse_label", twin(f"SELECT {PARSE_OUT} FROM parse_result"))
def l02(spark, sf):
    return (
        st.stars(spark, sf, "source_id", "raw_sptype")
        .select("source_id", LB.parse_label(F.col("raw_sptype")).alias("p"))
        .select("source_id", "p.*")
    )


@query("l03_ob_boundary", twin("SELECT source_id, ob AS is_boundary FROM parsed"))
def l03(spark, sf):
    return st.stars(spark, sf, "source_id", "raw_sptype").select(
        "source_id",
        LB.is_ob_boundary(F.regexp_replace(LB.normalize_label(F.col("raw_sptype")), " ", "")).alias(
            "is_boundary"
        ),
    )


@query(
    "l04_luminosity_prefix",
    twin(
        """SELECT source_id, CASE WHEN x IN ('IA+', 'IA') THEN replace(x, 'A', 'a') WHEN x = 'IAB' THEN 'Iab' WHEN x = 'IB' THEN 'Ib'
  ELSE nullif(x, '') END AS luminosity_class, nullif(trim(v[len(x) + 1:]), '') AS suffix FROM (
  SELECT source_id, v, regexp_extract(v, '^(IA[+]|IAB|IA|IB|III|VII|VI|IV|II|I|V|0)', 1) AS x FROM (
  SELECT source_id, upper(coalesce(luminosity_class, 'E')) || CASE WHEN source_id % 4 = 0 THEN ' N' ELSE '' END AS v FROM stars))"""
    ),
)
def l04(spark, sf):
    text = F.concat(
        F.upper(F.coalesce("luminosity_class", F.lit("E"))),
        F.when(F.col("source_id") % 4 == 0, " N").otherwise(""),
    )
    return st.stars(spark, sf, "source_id", "luminosity_class").select(
        "source_id",
        LB.luminosity_code(text).alias("luminosity_class"),
        LB.luminosity_rest(text).alias("suffix"),
    )


@query("l05_filtered_rows", twin("SELECT * FROM cat_filtered"))
def l05(spark, sf):
    return filtered(spark, sf)


@query("l05_rejected_rows", twin("SELECT * FROM cat_rejected"))
def l05_rejected(spark, sf):
    return cat.rejected_frame(classified(spark, sf))


@query(
    "l06_raw_rows",
    twin("SELECT * FROM catalog WHERE ra_deg IS NOT NULL AND raw_sptype IS NOT NULL"),
)
def l06(spark, sf):
    return cat.raw_frame(classified(spark, sf))


@query(
    "l07_import_summary",
    twin(
        """SELECT count(*) AS total_rows, count(ra_deg) AS rows_with_coordinates, count(raw_sptype) AS rows_with_raw_sptype,
  count(*) FILTER (WHERE regexp_matches(raw_sptype, '^[OBAFGKM]')) AS rows_with_supported_spectral_prefix,
  count(*) FILTER (WHERE ra_deg IS NOT NULL AND raw_sptype IS NOT NULL) AS exported_rows FROM catalog"""
    ),
)
def l07(spark, sf):
    return cat.import_summary(classified(spark, sf))


@query(
    "l08_filter_summary",
    twin(
        """SELECT count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'filtered') AS filtered_rows,
  count(*) FILTER (WHERE outcome <> 'filtered') AS rejected_rows, count(*) FILTER (WHERE outcome = 'filtered') AS rows_ready_for_gaia_crossmatch,
  count(*) FILTER (WHERE outcome = 'missing_coordinates') AS rejected_missing_coordinates,
  count(*) FILTER (WHERE outcome = 'missing_raw_sptype') AS rejected_missing_raw_sptype,
  count(*) FILTER (WHERE outcome = 'unsupported_spectral_prefix') AS rejected_unsupported_spectral_prefix FROM classified"""
    ),
)
def l08(spark, sf):
    return cat.filter_summary(classified(spark, sf))


@query("s16_filtered_csv", twin("SELECT * FROM cat_filtered"))
def s16(spark, sf):
    path = cat.write_csv(filtered(spark, sf), scratch_path(spark, "filtered-csv"), C.FILTERED_COLUMNS)
    return cat.read_csv(spark, path, C.FILTERED_COLUMNS)


@query(
    "s17_catalogue_export",
    twin(
        """SELECT 'filtered' AS layer, count(*) AS n_rows FROM cat_filtered UNION ALL SELECT 'rejected', count(*) FROM cat_rejected
  UNION ALL SELECT 'raw', count(*) FROM catalog WHERE ra_deg IS NOT NULL AND raw_sptype IS NOT NULL"""
    ),
)
def s17(spark, sf):
    export = cat.export_catalogue(scan(spark, sf), scratch_path(spark, "export"))
    columns = {"raw": C.RAW_COLUMNS, "filtered": C.FILTERED_COLUMNS, "rejected": C.REJECTED_COLUMNS}
    out = None
    for layer, path in export.paths.items():
        part = cat.read_csv(spark, path, columns[layer]).agg(F.count("*").alias("n_rows"))
        part = part.select(F.lit(layer).alias("layer"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s18_replace_tables",
    twin(
        """SELECT 'filtered' AS layer, count(*) AS rows_loaded FROM cat_filtered UNION ALL SELECT 'rejected', count(*) FROM cat_rejected
  UNION ALL SELECT 'raw', count(*) FROM catalog WHERE ra_deg IS NOT NULL AND raw_sptype IS NOT NULL"""
    ),
)
def s18(spark, sf):
    export = cat.export_catalogue(scan(spark, sf), scratch_path(spark, "export"))
    root = scratch_path(spark, "catalogue-tables")
    return cat.load_exports(spark, export, {n: f"{root}/{n}" for n in ("raw", "filtered", "rejected")})


@query("s20_upload_rows", twin(f"SELECT {', '.join(C.UPLOAD_COLUMNS)} FROM cat_filtered"))
def s20(spark, sf):
    return cat.upload_rows(filtered(spark, sf))


@query(
    "p12_luminosity_stage",
    twin(
        """SELECT source_id, CASE WHEN luminosity_class IN ('V', 'VI', 'VII') THEN 'dwarf' WHEN luminosity_class IS NOT NULL THEN 'evolved' END
  AS evolution_stage FROM stars"""
    ),
)
def p12(spark, sf):
    return st.stars(spark, sf, "source_id", "luminosity_class").select(
        "source_id",
        LB.stage_of_luminosity(F.concat(F.lit(" "), F.lower("luminosity_class"))).alias("evolution_stage"),
    )


@query(
    "p22_family_label",
    twin(
        "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN NULL ELSE 'G' || (source_id % 10) END AS label FROM stars"
    ),
)
def p22(spark, sf):
    raw = F.expr(
        "CASE source_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN CAST(source_id % 10 AS STRING) "
        "ELSE concat(' g', CAST(source_id % 10 AS STRING)) END"
    )
    return st.stars(spark, sf, "source_id").select(
        "source_id", LB.family_label(clean_text(raw), "G").alias("label")
    )
