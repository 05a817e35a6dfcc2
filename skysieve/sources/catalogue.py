"""External catalogue of spectral types: fixed-width scan, clean-up, classification, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skysieve import contracts as C
from skysieve.functions.labels import parse_label
from skysieve.functions.numeric import clean_text, no_nan
from skysieve.operators.distributions import count_flags
from skysieve.session import materialise

# --- fixed values: byte table of the catalogue, 141-byte records ------------------------

BYTE_TABLE = {
    "Bibcode": (1, 19, "string"),
    "Name": (22, 48, "string"),
    "RAh": (50, 51, "int"),
    "RAm": (53, 54, "int"),
    "RAs": (56, 60, "double"),
    "DE-": (62, 62, "string"),
    "DEd": (63, 64, "int"),
    "DEm": (66, 67, "int"),
    "DEs": (69, 72, "double"),
    "Mag": (76, 80, "double"),
    "SpType": (84, 109, "string"),
    "Remarks": (111, 141, "string"),
}
CATALOG_NAME = "bmk"


def cut_fields(lines: DataFrame, text: str = "value") -> DataFrame:
    """Cut fixed-width records into typed columns; blank or unreadable cells are missing."""
    other = [c for c in lines.columns if c != text]

    def field(first: int, last: int, kind: str) -> Column:
        cell = clean_text(F.substring(text, first, last - first + 1))
        return cell if kind == "string" else cell.try_cast(kind)

    return lines.select(
        *other, *[field(*spec).alias(name) for name, spec in BYTE_TABLE.items()]
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 0-based number in file order (P20).

    The numbers inside one input split follow from the row counter of its task;
    counts per split, a small table, give the offset. No rows move.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    in_file = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # one row per file of the catalogue: the only global order needed
    over_files = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = (
        splits.groupBy("_file")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_file_offset", F.coalesce(F.sum("_m").over(over_files), F.lit(0)))
        .drop("_m")
    )
    offsets = (
        splits.withColumn("_offset", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
        .join(files, "_file")
        .select("_file", "_block", "_first", (F.col("_offset") + F.col("_file_offset")).alias("_offset"))
    )
    return lines.join(offsets, ["_file", "_block"]).select(
        (F.col("_offset") + F.col("_at") - F.col("_first")).alias("external_row_id"), "value"
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return cut_fields(numbered_lines(spark, path))


def icrs_degrees() -> tuple[Column, Column]:
    """RA and Dec in degrees; both missing when any part is."""
    parts = ("RAh", "RAm", "RAs", "DE-", "DEd", "DEm", "DEs")
    complete = F.lit(True)
    for p in parts:
        complete = complete & F.col(p).isNotNull()
    ra = F.lit(15.0) * (F.col("RAh") + F.col("RAm") / 60.0 + F.col("RAs") / 3600.0)
    dec = F.col("DEd") + F.col("DEm") / 60.0 + F.col("DEs") / 3600.0
    signed = F.when(F.col("DE-") == "-", -dec).otherwise(dec)
    return F.when(complete, ra), F.when(complete, signed)


def base_records(table: DataFrame) -> DataFrame:
    """One cleaned record per catalogue row, in the raw column order."""
    ra, dec = icrs_degrees()
    return table.select(
        F.col("external_row_id").cast("long").alias("external_row_id"),
        F.lit(CATALOG_NAME).alias("external_catalog_name"),
        clean_text(F.col("Name")).alias("external_object_id"),
        ra.alias("ra_deg"),
        dec.alias("dec_deg"),
        clean_text(F.col("SpType")).alias("raw_sptype"),
        no_nan(F.col("Mag").cast("double")).alias("raw_magnitude"),
        clean_text(F.col("Bibcode")).alias("raw_source_bibcode"),
        clean_text(F.col("Remarks")).alias("raw_notes"),
    )


def classify(records: DataFrame) -> DataFrame:
    """Parse the label once and give every record its outcome."""
    placed = F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()
    labelled = F.col("raw_sptype").isNotNull()
    known = F.coalesce(F.col("label.spectral_class").isin(*C.SPECTRAL_CLASSES), F.lit(False))
    return (
        records.withColumn("label", parse_label(F.col("raw_sptype")))
        .withColumns({"has_coordinates": placed, "has_raw_sptype": labelled})
        .withColumn(
            "outcome",
            F.when(~placed, "missing_coordinates")
            .when(~labelled, "missing_raw_sptype")
            .when(~known, "unsupported_spectral_prefix")
            .otherwise("filtered"),
        )
    )


def raw_frame(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("has_coordinates") & F.col("has_raw_sptype")).select(*C.RAW_COLUMNS)


def filtered_frame(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == "filtered").select(
        *C.RAW_COLUMNS,
        F.col("label.spectral_class").alias("spectral_prefix"),
        "label.spectral_class",
        "label.spectral_subclass",
        "label.luminosity_class",
        "label.parse_status",
        "label.parse_note",
        F.lit(True).alias("has_supported_prefix"),
        "has_coordinates",
        "has_raw_sptype",
        F.lit(True).alias("ready_for_gaia_crossmatch"),
    )


def rejected_frame(classified: DataFrame) -> DataFrame:
    tried = F.col("outcome") == "unsupported_spectral_prefix"
    return classified.where(F.col("outcome") != "filtered").select(
        *C.RAW_COLUMNS,
        F.when(tried, F.col("label.spectral_class")).alias("spectral_prefix"),
        F.col("outcome").alias("reject_reason"),
    )


def import_summary(classified: DataFrame) -> DataFrame:
    """Counts of the import; the prefix test looks at the raw text, case and all."""
    return classified.agg(
        F.count("*").alias("total_rows"),
        *count_flags(
            {
                "rows_with_coordinates": F.col("has_coordinates"),
                "rows_with_raw_sptype": F.col("has_raw_sptype"),
                "rows_with_supported_spectral_prefix": F.col("raw_sptype").rlike("^[OBAFGKM]"),
                "exported_rows": F.col("has_coordinates") & F.col("has_raw_sptype"),
            }
        ),
    )


def filter_summary(classified: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return classified.agg(
        F.count("*").alias("total_rows"),
        *count_flags(
            {
                "filtered_rows": outcome == "filtered",
                "rejected_rows": outcome != "filtered",
                "rows_ready_for_gaia_crossmatch": outcome == "filtered",
                "rejected_missing_coordinates": outcome == "missing_coordinates",
                "rejected_missing_raw_sptype": outcome == "missing_raw_sptype",
                "rejected_unsupported_spectral_prefix": outcome == "unsupported_spectral_prefix",
            }
        ),
    )


def upload_rows(filtered: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that go to the sky match, in row order."""
    out = (
        filtered.where(
            F.col("ready_for_gaia_crossmatch")
            & F.col("ra_deg").isNotNull()
            & F.col("dec_deg").isNotNull()
            & F.col("raw_sptype").isNotNull()
        )
        .select(*C.UPLOAD_COLUMNS)
        .orderBy("external_row_id")
    )
    return out if limit is None else out.limit(limit)


# --- exports --------------------------------------------------------------------------

_DOUBLES = ("ra_deg", "dec_deg", "raw_magnitude", "xmatch_separation_arcsec")
_LONGS = ("external_row_id", "source_id", "source_conflict_count")


def csv_schema(columns) -> T.StructType:
    """Types of an exported table; the subclass digit stays a nullable integer."""

    def kind(name):
        if name in _DOUBLES:
            return T.DoubleType()
        if name in _LONGS:
            return T.LongType()
        if name == "spectral_subclass":
            return T.IntegerType()
        if name.startswith("has_") or name.startswith("ready_"):
            return T.BooleanType()
        return T.StringType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def write_csv(df: DataFrame, path: str, columns) -> str:
    """Fixed column order, header, missing cells empty."""
    df.select(*columns).write.mode("overwrite").csv(
        path, header=True, nullValue="", emptyValue='""', quote='"', escape='"'
    )
    return path


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    return spark.read.schema(csv_schema(columns)).csv(
        path, header=True, nullValue="", quote='"', escape='"'
    )


@dataclass(frozen=True)
class CatalogueExport:
    paths: dict[str, str]
    import_summary: DataFrame
    filter_summary: DataFrame


def export_catalogue(table: DataFrame, output_dir: str) -> CatalogueExport:
    """Parse once, then write the raw, filtered and rejected tables and count both summaries."""
    classified = materialise(classify(base_records(table)), "catalogue-classified")
    frames = {
        "raw": (raw_frame(classified), C.RAW_COLUMNS),
        "filtered": (filtered_frame(classified), C.FILTERED_COLUMNS),
        "rejected": (rejected_frame(classified), C.REJECTED_COLUMNS),
    }
    root = output_dir.rstrip("/")
    paths = {
        name: write_csv(df, f"{root}/bmk_external_{name}", columns)
        for name, (df, columns) in frames.items()
    }
    return CatalogueExport(paths, import_summary(classified), filter_summary(classified))


def load_exports(spark: SparkSession, export: CatalogueExport, tables: dict[str, str]) -> DataFrame:
    """Replace the three catalogue tables from the exports; returns loaded row counts."""
    columns = {"raw": C.RAW_COLUMNS, "filtered": C.FILTERED_COLUMNS, "rejected": C.REJECTED_COLUMNS}
    loaded = None
    for layer, target in tables.items():
        read_csv(spark, export.paths[layer], columns[layer]).write.mode("overwrite").parquet(target)
        count = spark.read.parquet(target).agg(F.count("*").alias("rows_loaded")).withColumn(
            "layer", F.lit(layer)
        )
        loaded = count if loaded is None else loaded.unionByName(count)
    return loaded.select("layer", "rows_loaded")


