"""Label parser cases and the catalogue scan from text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysieve.functions.labels import family_digit, parse_label, stage_of_luminosity
from skysieve.sources import catalogue as cat

CASES = [
    ("G2V", "G", 2, "V", None, "parsed", None),
    ("M2I", "M", 2, "I", None, "parsed", None),
    ("K7 III", "K", 7, "III", None, "parsed", None),
    ("G2VFE-1", "G", 2, "V", "FE-1", "parsed", None),
    ("B9.5V", "B", None, "V", None, "partial", "fractional_subclass_requires_separate_policy"),
    ("G2", "G", 2, None, None, "partial", "missing_luminosity_class"),
    ("OB-", "OB", None, None, "OB-", "partial", "ambiguous_ob_boundary_label"),
    ("O9.5/B0IV/V", "OB", None, None, "O9.5/B0IV/V", "partial", "ambiguous_ob_boundary_label"),
    ("   ", None, None, None, None, "empty", "empty_label"),
    ("WD", None, None, None, "WD", "unsupported", "missing_supported_spectral_class"),
    ("giii", "G", None, "III", None, "partial", "missing_integer_subclass"),
    ("F5 Ia+ e", "F", 5, "Ia+", "E", "parsed", None),
    ("A0Iab", "A", 0, "Iab", None, "parsed", None),
    ("K1VIIp", "K", 1, "VII", "P", "parsed", None),
    ("M00", "M", 0, "0", None, "parsed", None),
    ("G9.x", "G", 9, None, ".X", "partial", "missing_luminosity_class"),
]


def test_parse_label(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    rows = df.select("i", parse_label(F.col("raw")).alias("p")).select("i", "p.*").orderBy("i").collect()
    got = [
        (r.spectral_class, r.spectral_subclass, r.luminosity_class, r.peculiarity_suffix, r.parse_status, r.parse_note)
        for r in rows
    ]
    assert got == [c[1:] for c in CASES]


def test_stage_of_luminosity(spark):
    df = spark.createDataFrame([(x,) for x in (" v ", "VI", "iab", "0", "X", "")], "x string")
    assert [r[0] for r in df.select(stage_of_luminosity(F.col("x"))).collect()] == [
        "dwarf", "dwarf", "evolved", "evolved", None, None,
    ]


@pytest.mark.parametrize("value, digit", [("3", "3"), ("g3", "3"), ("K3", None), ("12", None), ("2.0", "2"), ("2.5", None), ("", None)])
def test_family_digit(spark, value, digit):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(family_digit(F.col("x"), "G")).first()[0] == digit


def record(n, ra="01 02 03.00", dec="-10 20 30.0", sp="G2V"):
    line = " " * 141
    for start, text in ((1, f"REF{n}"), (22, f"HD {n}"), (50, ra), (62, dec), (76, "12.34"), (84, sp), (111, "note")):
        line = line[: start - 1] + text + line[start - 1 + len(text):]
    return line


def test_row_numbers_over_many_splits(spark, tmp_path):
    """Numbers follow the file order across files and input splits."""
    n = 3000
    for part in range(3):
        body = "\n".join(record(i) for i in range(part * n, (part + 1) * n)) + "\n"
        (tmp_path / f"part-{part}.dat").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = cat.read_catalogue(spark, str(tmp_path)).select("external_row_id", "Bibcode").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3 * n
    assert all(r.Bibcode == f"REF{r.external_row_id}" for r in rows)


def test_catalogue_outcomes(spark, tmp_path):
    lines = [record(0), record(1, ra=" " * 11), record(2, sp=""), record(3, sp="OB-"), record(4, sp="wd")]
    (tmp_path / "c.dat").write_text("\n".join(lines) + "\n")
    export = cat.export_catalogue(cat.read_catalogue(spark, str(tmp_path / "c.dat")), str(tmp_path / "out"))
    s = export.filter_summary.first()
    assert (s.total_rows, s.filtered_rows, s.rejected_rows) == (5, 1, 4)
    assert (s.rejected_missing_coordinates, s.rejected_missing_raw_sptype, s.rejected_unsupported_spectral_prefix) == (1, 1, 2)
    kept = cat.read_csv(spark, export.paths["filtered"], cat.C.FILTERED_COLUMNS).first()
    assert kept.spectral_subclass == 2 and kept.raw_magnitude == 12.34
    assert abs(kept.ra_deg - 15 * (1 + 2 / 60 + 3 / 3600)) < 1e-12
    assert abs(kept.dec_deg + (10 + 20 / 60 + 30 / 3600)) < 1e-12


def test_each_pattern_is_matched_once(spark):
    rows = spark.createDataFrame([("G2V",)], "t string").select(parse_label(F.col("t")).alias("p")).select("p.spectral_class")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("regexp_extract(") == 4
    assert rows.first().spectral_class == "G"
