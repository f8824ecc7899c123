"""Registry bundle: coded aircraft, engine and holder files to the registry tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordlens.functions import dates, fixed, text
from recordlens.operators.matching import reference_join, serial_guarded_history
from recordlens.sources import feeds
from recordlens.sources.tables import csv_scan, with_columns, with_normal_headers


def _any_case(name: str) -> str:
    return "".join(f"[{ch.upper()}{ch.lower()}]" if ch.isalpha() else ch for ch in name)


def registry_bundle_scan(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Bundle files found in the folder, in latin1, with normalised headers and trimmed cells."""
    out = {}
    for part, file in feeds.BUNDLE.items():
        try:
            raw = csv_scan(spark, f"{directory.rstrip('/')}/{_any_case(file)}",
                           encoding="ISO-8859-1", multi_line=False)
        except AnalysisException:
            continue
        out[part] = with_normal_headers(raw)
    return out


def decode_status(c: Column) -> Column:
    return text.lookup(F.trim(text.blank(c)), fixed.STATUS_CODES, F.trim(text.blank(c)))


def decode_registrant(c: Column) -> Column:
    return text.lookup(F.trim(text.blank(c)), fixed.REGISTRANT_TYPES, F.trim(text.blank(c)))


def decode_class(c: Column) -> Column:
    first = F.substring(F.trim(text.blank(c)), 1, 1)
    return text.lookup(first, fixed.AIRWORTHINESS_CLASSES, first)


def _coded(rows: DataFrame, bundle: dict[str, DataFrame]) -> DataFrame:
    named = rows.filter(~text.is_blank(F.col("N_NUMBER"))).withColumns(
        {c: F.lit("") for c in ("MFR_MDL_CODE", "ENG_MFR_MDL") if c not in rows.columns})
    return reference_join(named, {
        "ACFT": (bundle["acftref"], "MFR_MDL_CODE", "CODE", ["MFR", "MODEL"]),
        "ENG": (bundle["engine"], "ENG_MFR_MDL", "CODE", ["MFR", "MODEL"]),
    })


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def registry_current(bundle: dict[str, DataFrame]) -> DataFrame:
    m = _coded(bundle["master"], bundle)
    c = lambda n: _col(m, n)
    return m.select(
        F.concat(F.lit("N"), c("N_NUMBER")).alias("N_NUMBER"), c("SERIAL_NUMBER").alias("SERIAL_NUMBER"),
        F.col("ACFT_MFR").alias("MFR"), F.col("ACFT_MODEL").alias("MODEL"),
        F.col("ENG_MFR"), F.col("ENG_MODEL"), c("YEAR_MFR").alias("YEAR_MFR"),
        decode_registrant(c("TYPE_REGISTRANT")).alias("REGISTRANT_TYPE"),
        c("NAME").alias("REGISTRANT_NAME"), c("CITY").alias("CITY"), c("STATE").alias("STATE"),
        dates.compact_to_iso(c("CERT_ISSUE_DATE")).alias("CERT_ISSUE_DATE"),
        decode_class(c("CERTIFICATION")).alias("AIRWORTHINESS_CLASS"),
        decode_status(c("STATUS_CODE")).alias("STATUS"), c("MODE_S_CODE_HEX").alias("MODE_S_HEX"),
        dates.compact_to_iso(c("EXPIRATION_DATE")).alias("EXPIRATION_DATE"))


def registry_warnings(bundle: dict[str, DataFrame]) -> DataFrame:
    """Marks whose aircraft code is not in the reference file."""
    m = _coded(bundle["master"], bundle).filter("ACFT_UNKNOWN")
    return m.select(F.concat(F.lit("N"), "N_NUMBER").alias("N_NUMBER"), "MFR_MDL_CODE")


def deregistered(bundle: dict[str, DataFrame]) -> DataFrame:
    d = _coded(bundle["dereg"], bundle)
    c = lambda n: _col(d, n)
    out = d.select(
        F.concat(F.lit("N"), c("N_NUMBER")).alias("N_NUMBER"), c("SERIAL_NUMBER").alias("SERIAL_NUMBER"),
        F.col("ACFT_MFR").alias("MFR"), F.col("ACFT_MODEL").alias("MODEL"), "ENG_MFR", "ENG_MODEL",
        c("YEAR_MFR").alias("YEAR_MFR"), c("NAME").alias("REGISTRANT_NAME"), c("CITY").alias("CITY"),
        c("STATE").alias("STATE"), dates.compact_to_iso(c("CANCEL_DATE")).alias("CANCEL_DATE"),
        dates.compact_to_iso(c("LAST_ACT_DATE")).alias("LAST_ACT_DATE"),
        c("STATUS_CODE").alias("STATUS_CODE"))
    return with_columns(out, feeds.DEREGISTERED)


def cancellation_history(guarded: DataFrame) -> DataFrame:
    """History rows of the cancellations that belong to the current aircraft."""
    holder = F.when(text.is_blank(F.col("REGISTRANT_NAME")), "unknown").otherwise(
        F.col("REGISTRANT_NAME"))
    code = F.when(text.is_blank(F.col("STATUS_CODE")), "").otherwise(
        F.concat(F.lit(" (status "), F.col("STATUS_CODE"), F.lit(")")))
    return guarded.filter("KEEP").select(
        "N_NUMBER", F.col("CANCEL_DATE").alias("DATE"), F.lit("Registration cancelled").alias("EVENT"),
        F.concat(F.lit("Previous registrant: "), holder, code).alias("DETAILS"))


def registry_tables(spark: SparkSession, bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a bundle, by name."""
    current = registry_current(bundle)
    out = {"aircraft_registry_current": current, "registry": current}
    for part, name in feeds.BUNDLE_PASS_THROUGH.items():
        if part in bundle:
            out[name] = bundle[part]
    if "dereg" in bundle:
        out["deregistered_aircraft"] = deregistered(bundle)
        out["registration_history"] = cancellation_history(
            serial_guarded_history(out["deregistered_aircraft"], current))
    else:
        from recordlens.sources.tables import empty_table

        out["registration_history"] = empty_table(spark, feeds.HISTORY)
    return out
