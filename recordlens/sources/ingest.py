"""Staged ingest of the eight feeds from landed files, isolated from each other.

A feed is a function ``(spark, folder, store, as_of) -> (tables, status, confidence, warnings)``.
The registry comes first, because later feeds match against it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.functions import dates, text
from recordlens.operators import aggregates, matching
from recordlens.sources import documents, feeds, registry, tables
from recordlens.sources.store import TableStore, append_health, health_record

REGISTRY_ORDER = ("N_NUMBER", "MODEL")


class FeedProblem(Exception):
    """A feed that cannot be loaded, with the status to record."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


def landed_files(spark: SparkSession, folder: str, pattern: str = "*.[cC][sS][vV]") -> list[str]:
    """Paths of the landed files (a list from the file system, no content)."""
    try:
        listing = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r[0] for r in listing.select("path").collect())


def _union_files(spark: SparkSession, folder: str, headers: dict, essential: list[str]) -> DataFrame:
    layouts, refused, _ = tables.landed_tables(spark, landed_files(spark, folder), headers, essential)
    if refused:
        raise FeedProblem("VALIDATION_FAILED", f"unmapped essential columns: {refused[0][1]}")
    if not layouts:
        raise FeedProblem("ZERO_ROWS", f"no files in {folder}")
    return tables.union_all(layouts).drop(tables.SOURCE_PATH)


def load_registry(spark, folder, store, as_of):
    bundle = registry.registry_bundle_scan(spark, folder)
    missing = [feeds.BUNDLE[p] for p in feeds.BUNDLE_REQUIRED if p not in bundle]
    if missing:
        raise FeedProblem("VALIDATION_FAILED", f"bundle lacks {', '.join(missing)}")
    out = registry.registry_tables(spark, bundle)
    rows = out["registry"].count()
    if rows == 0:
        raise FeedProblem("ZERO_ROWS", "registry has no rows")
    warnings = [f"{rows} rows, fewer than 1000"] if rows < 1000 else []
    unknown = registry.registry_warnings(bundle).count()
    if unknown:
        warnings.append(f"{unknown} marks with an unknown aircraft code")
    return out, "high" if rows >= 1000 else "medium", warnings


def load_sdr(spark, folder, store, as_of):
    files = landed_files(spark, folder)
    if not files:
        raise FeedProblem("ZERO_ROWS", f"no files in {folder}")
    reports, lineage, skipped = tables.yearly_files(spark, files, feeds.SDR_HEADERS, feeds.SDR_ESSENTIAL)
    warnings = [f"{file}: {reason}" for file, reason in skipped]
    if reports is None:
        raise FeedProblem("ZERO_ROWS", f"no file has the essential columns: {' | '.join(warnings)}")
    empty = lineage.filter("ROWS = 0").select("FILE").collect()  # one row per file
    warnings += sorted(f"{r[0]}: no rows" for r in empty)
    reports = tables.with_columns(reports, feeds.SDR)
    out = {"sdr_reports": reports, "sdr": reports, "sdr_source_files": lineage}
    reg = store.production("aircraft_registry_current")
    if reg is None:
        warnings.append("no registry yet; matches left out")
    else:
        out["sdr_aircraft_matches"] = matching.match_tiers(
            reports, reg, id_col="REPORT_ID", registry_order=REGISTRY_ORDER)
        out["sdr_model_patterns"] = aggregates.model_patterns(reports, as_of=as_of)
    return out, "medium" if reg is None else "high", warnings


def load_ntsb(spark, folder, store, as_of):
    layouts, refused, _ = tables.landed_tables(
        spark, landed_files(spark, folder), feeds.NTSB_HEADERS, feeds.NTSB_ESSENTIAL)
    warnings = []
    for path, missing in refused:
        lost = ", ".join(f for f in missing if f in feeds.NTSB_ESSENTIAL)
        warnings.append(f"{path.rsplit('/', 1)[-1]}: no column for {lost}; the file is left out")
    parts = [(F.concat(F.lit("csv "), tables.SOURCE_PATH), rows.withColumns({
        "N_NUMBER": text.normalize_mark(F.col("N_NUMBER")), "SOURCE_MODE": F.lit("bulk")})) for rows in layouts]
    for path in landed_files(spark, folder, "*.[jJ][sS][oO][nN]"):
        body = spark.read.option("wholetext", True).text(path)
        if body.filter(F.try_parse_json("value").isNull()).count():
            warnings.append(f"{path.rsplit('/', 1)[-1]}: not readable as JSON; the file is left out")
            continue
        parts.append((F.lit(f"json {path} 1"), documents.eav_pivot_scan(body, "value", "api")))
        parts.append((F.lit(f"json {path} 2"), documents.ntsb_json(body, "value", "api")))
    if not parts:
        raise FeedProblem("ZERO_ROWS", " | ".join(["no events", *warnings]))
    # Later files win over earlier ones, JSON over CSV.
    rows = tables.union_all([p.withColumn("_file", file).select(
        *tables.columns_as_text(p, feeds.NTSB), "_file") for file, p in parts])
    key = F.when(F.col("EVENT_ID") != "", F.col("EVENT_ID")).otherwise(
        F.concat_ws("|", "DATE", "N_NUMBER"))
    events = aggregates.dedupe_last_wins(rows, key, ["_file", *feeds.NTSB]).drop("_file")
    out = {"ntsb_events": events, "ntsb": events}
    reg = store.production("aircraft_registry_current")
    if reg is None:
        warnings.append("no registry yet; matches left out")
    else:
        out["ntsb_registry_matches"] = matching.event_match_tiers(
            events, reg, registry_order=REGISTRY_ORDER)
    return out, "medium", warnings


def load_ads(spark, folder, store, as_of):
    layouts = tables.csv_layouts(spark, landed_files(spark, folder))
    if layouts:
        rows = tables.union_all([tables.with_columns(
            tables.csv_scan(spark, paths), feeds.ADS) for paths in layouts.values()])
        blank = F.lit("")
        directives = rows.select(
            "AD_NUMBER", blank.alias("FR_DOCUMENT_NUMBER"), F.col("SUBJECT").alias("TITLE"),
            F.col("NOTES").alias("ABSTRACT"), "EFFECTIVE_DATE", blank.alias("PUBLICATION_DATE"),
            blank.alias("RIN"), blank.alias("SOURCE_URL"))
        applicability = rows.select(
            "AD_NUMBER", "APPLIES_MFR", "APPLIES_MODEL", "APPLIES_ENG_MFR", "APPLIES_ENG_MODEL",
            F.lit("STRUCTURED").alias("APPLICABILITY_CONFIDENCE"))
        ads, confidence, warnings = rows, "high", []
        directives = aggregates.dedupe_last_wins(directives, F.col("AD_NUMBER"), feeds.DIRECTIVES)
    else:
        bodies = landed_files(spark, folder, "*.[jJ][sS][oO][nN]")
        if not bodies:
            raise FeedProblem("ZERO_ROWS", "no directives")
        body = spark.read.option("wholetext", True).text(bodies)
        directives = documents.federal_register_transform(body, "value")
        key = F.when(F.col("AD_NUMBER") != "", F.col("AD_NUMBER")).otherwise(
            F.col("FR_DOCUMENT_NUMBER"))
        directives = aggregates.dedupe_last_wins(directives, key, feeds.DIRECTIVES)
        reg = store.production("aircraft_registry_current")
        if reg is None:
            applicability = tables.empty_table(spark, feeds.APPLICABILITY)
            warnings = ["no registry yet; applicability left out"]
        else:
            hay = directives.withColumn("_text", F.concat_ws(" ", "TITLE", "ABSTRACT"))
            applicability = matching.text_vocab_join(
                hay, reg, id_col="AD_NUMBER", text_col="_text").withColumns(
                {"APPLIES_ENG_MFR": F.lit(""), "APPLIES_ENG_MODEL": F.lit("")}).select(
                *feeds.APPLICABILITY)
            warnings = ["applicability is inferred from text"]
        ads, confidence = matching.ads_view(applicability, directives), "low"
    return ({"airworthiness_directives": directives, "ad_applicability": applicability, "ads": ads},
            confidence, warnings)


def normalize_enforcement(rows: DataFrame, as_of: str) -> DataFrame:
    recent = F.coalesce(dates.text_age_days(F.col("DATE_CLOSED"), as_of) <= aggregates.FIVE_YEARS,
                        F.lit(False))
    return rows.withColumns({
        "CATEGORY": text.categorize(F.col("SUMMARY"), F.col("ACTION")),
        "RECENT": F.when(recent, "yes").otherwise("no")})


def load_enforcement(spark, folder, store, as_of):
    rows = _union_files(spark, folder, feeds.ENFORCEMENT_HEADERS, feeds.ENFORCEMENT_ESSENTIAL)
    actions = normalize_enforcement(rows, as_of)
    return ({"enforcement_actions": actions, "enforcement_entities": aggregates.entity_rollup(actions),
             "enforcement": actions.select(*feeds.ENFORCEMENT)}, "high", [])


def load_asrs(spark, folder, store, as_of):
    rows = _union_files(spark, folder, feeds.ASRS_HEADERS, feeds.ASRS_ESSENTIAL)
    rows = rows.withColumns({
        "THEMES": F.array_join(text.split_themes(F.col("THEMES")), ";"),
        "DATE": F.substring("DATE", 1, 10)})
    themes = aggregates.theme_counts(rows, text.split_themes(F.col("THEMES")))
    return ({"asrs_reports": rows, "asrs": rows, "asrs_human_factor_themes": themes}, "low",
            ["voluntary, unverified reports"])


def _airport_events(spark, folder, headers) -> DataFrame:
    rows = _union_files(spark, folder, headers, feeds.AIRPORT_ESSENTIAL)
    return rows.withColumns({"AIRPORT": F.upper("AIRPORT"), "DATE": F.substring("DATE", 1, 10)})


def _merged_risk(spark, store, counts, column) -> DataFrame:
    old = store.production("airport_risk")
    old = tables.empty_table(spark, feeds.AIRPORT_RISK) if old is None else old
    return matching.merge_metric_column(old, counts, "AIRPORT", column).select(*feeds.AIRPORT_RISK)


def load_incursions(spark, folder, store, as_of):
    rows = _airport_events(spark, folder, feeds.INCURSION_HEADERS)
    counts = aggregates.counts_within_years(rows, "AIRPORT", dates.as_date(F.col("DATE")), years=5,
                                            as_of=as_of)
    surface = counts.select("AIRPORT", F.col("n").cast("string").alias("INCURSIONS_5YR"))
    return ({"runway_incursions": rows, "airport_surface_risk": surface,
             "airport_risk": _merged_risk(spark, store, counts, "RUNWAY_INCURSIONS_5YR")},
            "medium", [])


def load_strikes(spark, folder, store, as_of):
    rows = _airport_events(spark, folder, feeds.STRIKE_HEADERS)
    counts = aggregates.counts_within_years(
        rows, "AIRPORT", dates.as_date(F.col("DATE")), years=5, as_of=as_of,
        subset=text.is_damaging(F.col("DAMAGE")))
    risk = counts.select("AIRPORT", F.col("n").cast("string").alias("STRIKES_5YR"),
                         F.col("n_subset").cast("string").alias("DAMAGING_STRIKES_5YR"))
    species = aggregates.category_counts(rows, "SPECIES").select(
        "SPECIES", F.col("n").cast("string").alias("STRIKE_COUNT"))
    return ({"wildlife_strikes": rows, "airport_wildlife_risk": risk, "species_risk": species,
             "airport_risk": _merged_risk(spark, store, counts.drop("n_subset"),
                                          "WILDLIFE_STRIKES_5YR")}, "medium", [])


# dependency order: the registry first, incursions before strikes
FEEDS = {
    "registry": load_registry, "sdr": load_sdr, "ntsb": load_ntsb, "ads": load_ads,
    "enforcement": load_enforcement, "asrs": load_asrs, "incursions": load_incursions,
    "strikes": load_strikes,
}


GRACE_SECONDS = 30  # how long a cancelled feed may take to notice


def within(spark: SparkSession, seconds: float | None, work: Callable):
    """The result of the work, whose Spark jobs are cancelled after so many seconds; None is no limit.

    The work's jobs carry a tag of their own, so no other job is touched. Work that waits outside of Spark
    is left behind after a grace period.
    """
    if seconds is None:
        return work()
    context, tag, got = spark.sparkContext, f"feed-{uuid.uuid4().hex}", {}

    def run():
        context.addJobTag(tag)
        try:
            got["result"] = work()
        except BaseException as error:  # raised again by the caller's thread
            got["error"] = error

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        for _ in range(2 * GRACE_SECONDS):  # a feed may just be between two jobs
            context.cancelJobsWithTag(tag)
            thread.join(0.5)
            if not thread.is_alive():
                break
        raise FeedProblem("SOURCE_UNAVAILABLE", f"no result within {seconds:g} s; its jobs were cancelled")
    if "error" in got:
        raise got["error"]
    return got["result"]


def run_feed(spark: SparkSession, name: str, folder: str, base: str, *, as_of: str,
             accept_schema_change: bool = False, feeds_by_name: dict | None = None,
             seconds: float | None = None) -> dict:
    """One feed: load, stage, compare columns, promote. Always returns a health record.

    Loading and staging may take ``seconds``; what came too late is never promoted.
    """
    started = datetime.now(timezone.utc).isoformat()
    store = TableStore(spark, base)
    done = lambda **f: health_record(
        name, started, datetime.now(timezone.utc).isoformat(), **f)
    loader = (feeds_by_name or FEEDS).get(name)
    if loader is None:
        return done(status="SOURCE_UNAVAILABLE", error_message=f"unknown source {name}",
                    confidence="none")
    try:
        def load():
            out, confidence, warnings = loader(spark, folder, store, as_of)
            return [store.stage(name, t, df) for t, df in out.items()], confidence, warnings

        staged, confidence, warnings = within(spark, seconds, load)
        changes = store.schema_changes(staged)
        if changes and not accept_schema_change:
            changed = ", ".join(c["table"] for c in changes)
            return done(status="SCHEMA_CHANGED", records_loaded=0, confidence="low",
                        error_message=f"columns changed for {changed}; nothing promoted")
        store.promote(staged)
        return done(status="OK_WITH_WARNINGS" if warnings else "OK", confidence=confidence,
                    records_loaded=sum(s["rows"] for s in staged),
                    error_message=" | ".join(warnings))
    except FeedProblem as problem:
        return done(status=problem.status, error_message=problem, confidence="none")
    except Exception as error:  # one feed must never stop the others
        return done(status="SOURCE_UNAVAILABLE", error_message=f"failed: {error}", confidence="none")


def run_ingest(spark: SparkSession, folders: dict[str, str], base: str, *, as_of: str,
               accept_schema_change: bool = False, feeds_by_name: dict | None = None,
               seconds: float | None = None) -> list[dict]:
    """Feeds in dependency order, each on its own and within its time; every run is logged."""
    order = list(feeds_by_name or FEEDS)
    names = sorted(folders, key=lambda n: order.index(n) if n in order else len(order))
    records = [run_feed(spark, n, folders[n], base, as_of=as_of, feeds_by_name=feeds_by_name,
                        accept_schema_change=accept_schema_change, seconds=seconds) for n in names]
    append_health(spark, base, records)
    return records
