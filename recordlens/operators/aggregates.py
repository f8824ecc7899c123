"""Grouped summaries: counts in windows of time, rates, rollups, weighted scores, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.functions import dates, fixed, numbers, text
from recordlens.operators.ordered import nth_smallest, pick_row, top_n
from recordlens.session import cut

THREE_YEARS = 3 * 365
FIVE_YEARS = 5 * 365


def chapter_themes(records: DataFrame, entity: str, *, at_least: int = 2, top: int = 4) -> DataFrame:
    """Largest chapters per entity with at least two records."""
    n = records.groupBy(entity, text.chapter_of(F.col("JASC_CODE")).alias("CHAPTER")).agg(
        F.count("*").alias("n"))
    return top_n(n.filter(F.col("n") >= at_least), [entity], [F.desc("n"), F.asc("CHAPTER")], top)


def model_patterns(records: DataFrame, *, as_of: str) -> DataFrame:
    """Report and recent-report counts per maker, model and chapter."""
    age = dates.text_age_days(F.col("DATE"), as_of)
    known = records.filter(~text.is_blank(F.col("MFR")) & ~text.is_blank(F.col("MODEL")))
    return known.groupBy("MFR", "MODEL", text.chapter_of(F.col("JASC_CODE")).alias("JASC_CHAPTER")) \
        .agg(F.count("*").alias("REPORT_COUNT"),
             F.count_if(age <= THREE_YEARS).alias("RECENT_COUNT"))


def entity_rollup(actions: DataFrame) -> DataFrame:
    action, amount = text.blank(F.col("ACTION")), text.blank(F.col("AMOUNT"))
    return actions.groupBy("RESPONDENT").agg(
        F.count("*").alias("ACTION_COUNT"),
        F.count_if(action.rlike(r"(?i)revocation|suspension")).alias("CERTIFICATE_ACTIONS"),
        F.count_if(action.rlike(r"(?i)penalty") | (amount != "")).alias("CIVIL_PENALTY_COUNT"),
    )


def theme_counts(rows: DataFrame, themes: Column) -> DataFrame:
    return rows.select(F.explode(themes).alias("THEME")).groupBy("THEME").agg(
        F.count("*").alias("REPORT_COUNT"))


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(~text.is_blank(F.col(column))).groupBy(column).agg(
        F.count("*").alias("n"))


def in_last_years(d: Column, years: int, as_of: str) -> Column:
    """Undated rows count; dated rows must lie within the window and not in the future."""
    age = dates.age_days(d, as_of)
    return age.isNull() | age.between(0, years * 365)


def counts_within_years(rows: DataFrame, key: str, d: Column, *, years: int, as_of: str,
                        subset: Column | None = None) -> DataFrame:
    """Rows per key in the window, and how many of them meet a second condition."""
    keyed = rows.withColumn("_key", F.upper(text.blank(F.col(key).cast("string")))).filter(
        (F.col("_key") != "") & in_last_years(d, years, as_of))
    aggs = [F.count("*").alias("n")]
    if subset is not None:
        aggs.append(F.count_if(subset).alias("n_subset"))
    return keyed.groupBy(F.col("_key").alias(key)).agg(*aggs)


# ------------------------------------------------------------------ carriers
def crash_summary(crashes: DataFrame, *, as_of: str, months: int = 24) -> DataFrame:
    """Lifetime and rolling crash figures per carrier; dates are compact text.

    Ids are made distinct first, so a carrier with very many crashes is merged on the map side.
    """
    cut = F.date_format(dates.rolling_cutoff(as_of, months), "yyyyMMdd")
    recent = F.col("report_date") >= cut
    per_id = crashes.groupBy("dot_number", "crash_id").agg(
        F.count("*").alias("rows"),
        F.min("report_date").alias("first"), F.max("report_date").alias("last"),
        F.count_if(recent).alias("recent"),
        F.sum(F.when(recent, numbers.int_or_zero(F.col("fatalities")))).alias("fatal"),
        F.sum(F.when(recent, numbers.int_or_zero(F.col("injuries")))).alias("injuries"),
        # fixed pattern of the feed's yes values: any 1 or t counts as well
        F.count_if(recent & text.blank(F.col("tow_away")).rlike(r"(?i)^y|1|t")).alias("tow"),
    )
    return per_id.groupBy("dot_number").agg(
        F.sum("rows").alias("lifetime_total"),
        F.count("crash_id").alias("lifetime_distinct"),
        dates.compact_to_iso(F.min("first")).alias("first_date"),
        dates.compact_to_iso(F.max("last")).alias("last_date"),
        F.sum("recent").alias("recent_total"),
        F.coalesce(F.sum("fatal"), F.lit(0)).alias("recent_fatal"),
        F.coalesce(F.sum("injuries"), F.lit(0)).alias("recent_injuries"),
        F.sum("tow").alias("recent_tow_away"),
    )


def inspection_rates(inspections: DataFrame, *, as_of: str, months: int = 24) -> DataFrame:
    """Rolling inspection counts and out-of-service rates (one decimal, NULL without data)."""
    cut = F.date_format(dates.rolling_cutoff(as_of, months), "yyyyMMdd")
    recent = F.col("insp_date") >= cut
    positive = lambda c: recent & (numbers.int_or_zero(F.col(c)) > 0)
    sums = inspections.groupBy("dot_number").agg(
        F.count("*").alias("file_total"),
        dates.compact_to_iso(F.min("insp_date")).alias("window_start"),
        dates.compact_to_iso(F.max("insp_date")).alias("window_end"),
        F.count_if(recent).alias("recent_total"),
        F.count_if(positive("vehicle_oos_total")).alias("recent_vehicle_oos"),
        F.count_if(positive("driver_oos_total")).alias("recent_driver_oos"),
        F.count_if(positive("viol_total")).alias("recent_with_violation"),
    )

    def pct(c: str) -> Column:
        share = numbers.ratio(F.col(c), F.col("recent_total"))
        return numbers.half_up(share * 1000) / F.lit(10.0)

    return sums.withColumns({
        "vehicle_oos_pct": pct("recent_vehicle_oos"), "driver_oos_pct": pct("recent_driver_oos")})


# ------------------------------------------------------------------ activity
def profile_aggregates(as_of: str) -> list[Column]:
    """Per-mark sums over flights: counts, local flights, minutes, recent counts, last date."""
    d = dates.as_date(F.col("DATE"))
    age = dates.age_days(d, as_of)
    return [
        F.count("*").alias("flights"),
        F.count_if(F.col("ORIGIN") == F.col("DEST")).alias("local"),
        F.sum(F.coalesce(numbers.number(F.col("DURATION_MIN")), F.lit(0.0))).alias("minutes"),
        F.count_if(age.between(0, 90)).alias("recent_90"),
        F.count_if(age.between(0, 365)).alias("recent_365"),
        F.max(d).alias("last_date"),
    ]


def activity_profile(stepped: DataFrame, *, as_of: str, extra: list[Column] = ()) -> DataFrame:
    """Per mark: flight counts, local share, mean minutes, last date and longest gap.

    ``stepped`` are flights with the gap to the flight before (with_flight_gap).
    """
    sums = stepped.groupBy("ENTITY").agg(
        *profile_aggregates(as_of), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), *extra)
    return sums.withColumns({
        "local_share": F.col("local") / F.col("flights"),
        "mean_minutes": F.col("minutes") / F.col("flights"),
    })


def mode_first_tie(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent value per key; among equals the one seen first."""
    counts = rows.groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value),
        F.max("_n").alias("n"),
    )


# ------------------------------------------------------------------ scores
def composite_score(modules: DataFrame, entity: str = "ENTITY") -> DataFrame:
    """Weighted mean over the modules with a known weight (columns MODULE, SCORE)."""
    w = text.lookup(F.col("MODULE"), fixed.MODULE_WEIGHTS)
    return modules.groupBy(entity).agg(
        F.sum(w * F.col("SCORE")).alias("_ws"), F.sum(w).alias("_w")
    ).select(entity, F.coalesce(numbers.half_up(numbers.ratio(F.col("_ws"), F.col("_w"))),
                                F.lit(0)).cast("int").alias("SCORE"))


def report_confidence(identity: Column, with_data: Column, total: Column) -> Column:
    """Identity confidence limited by the share of modules that had data."""
    share = F.coalesce(numbers.ratio(with_data, total), F.lit(0.0))
    rank = text.lookup(identity, {"none": 0, "low": 1, "medium": 2, "high": 3}, F.lit(0))
    return (
        F.when(rank == 0, "none").when((rank >= 3) & (share >= 0.6), "high")
        .when((rank >= 2) & (share >= 0.4), "medium").otherwise("low")
    )


def batch_coverage(records: DataFrame) -> DataFrame:
    """One row: how many were submitted, resolved, evidenced, and whether the gate passes."""
    yes = F.col("RESOLVED") == "yes"
    direct = (F.col("SDR_TAIL_SCORE") > 0) | (F.col("NTSB_DIRECT_EVENT_SCORE") > 0)
    out = records.agg(
        F.count("*").alias("submitted"), F.count_if(yes).alias("resolved"),
        F.count_if(yes).alias("scored"),
        F.count_if(yes & (F.col("EVIDENCE_COUNT") > 0)).alias("with_evidence"),
        F.count_if(yes & direct).alias("with_direct_signal"),
    )
    return out.withColumn(
        "gate_pass", (F.col("submitted") > 0) & (F.col("resolved") == F.col("submitted"))
        & (F.col("scored") == F.col("resolved")))


# ------------------------------------------------------------------ quality results
def check_rollup(results: DataFrame, key: str = "probe_id") -> DataFrame:
    """Check rows of a probe to its result: dimensions, completeness, success, failure texts.

    A probe has as many rows as its contract has checks, so the failure list is short by nature.
    """
    ok = F.col("ok")

    def dimension(name: str) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("dimension") == name, ok)), F.lit(True))

    failure = F.concat(F.col("type"), F.lit(" ["), F.col("dimension"), F.lit("]: "),
                       text.blank(F.col("detail")))
    # the first check that reports rows decides completeness
    counted = F.when(F.col("rows_found").isNotNull(),
                     F.struct("check_idx", "rows_found", "rows_expected"))
    g = results.groupBy(key).agg(
        F.coalesce(F.bool_and(F.when(F.col("critical"), ok)), F.lit(True)).alias("task_success"),
        dimension("availability").alias("available"),
        dimension("schema").alias("schema_valid"),
        dimension("join_keys").alias("join_keys_valid"),
        dimension("freshness").alias("freshness_valid"),
        F.count_if(ok).alias("checks_passed"), F.count("*").alias("checks_total"),
        F.min(counted).alias("_rows"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("check_idx", failure.alias("f"))))).alias("_f"),
    )
    by_rows = F.least(F.lit(1.0), F.col("_rows.rows_found") /
                      F.greatest(F.lit(1), F.col("_rows.rows_expected")))
    share = F.when(F.col("_rows").isNotNull(), by_rows).otherwise(
        F.col("checks_passed") / F.col("checks_total"))
    return g.withColumn("completeness_score", numbers.half_up_to(share, 3)).withColumn(
        "failures", F.col("_f.f")).drop("_rows", "_f")


def history_stats(history: DataFrame, *, as_of: str) -> DataFrame:
    """Success rate and probe count of the last 7 and 30 days per source."""
    now = F.lit(as_of).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    in7 = ts >= now - F.expr("INTERVAL 7 DAYS")
    in30 = ts >= now - F.expr("INTERVAL 30 DAYS")
    g = history.groupBy("source").agg(
        F.count_if(in7).alias("probes_7d"), F.count_if(in30).alias("probes_30d"),
        F.count_if(in7 & F.col("task_success")).alias("_ok7"),
        F.count_if(in30 & F.col("task_success")).alias("_ok30"),
    )

    def rate(ok: str, n: str) -> Column:
        return numbers.half_up_to(numbers.ratio(F.col(ok), F.col(n)), 3)

    return g.select("source", rate("_ok7", "probes_7d").alias("success_rate_7d"),
                    rate("_ok30", "probes_30d").alias("success_rate_30d"),
                    "probes_7d", "probes_30d")


DAY_SCHEMA = "source long, probes long, passed long, changes long, first_hash string, last_hash string, day date"


def daily_history(history: DataFrame, order: list[str]) -> DataFrame:
    """One mergeable row per source and day: probes, passes, schema changes, first and last schema hash."""
    day = F.to_date(F.col("ts").cast("timestamp"))
    place = F.struct(*order)
    hashed = F.col("schema_hash").isNotNull()
    before = F.lag("schema_hash").over(Window.partitionBy("source", "day", hashed).orderBy(*order))
    rows = history.withColumn("day", day).withColumn("_changed", hashed & (before != F.col("schema_hash")))
    return rows.groupBy("source", "day").agg(
        F.count("*").alias("probes"), F.count_if("task_success").alias("passed"),
        F.count_if("_changed").alias("changes"),
        F.min_by("schema_hash", F.when(hashed, place)).alias("first_hash"),
        F.max_by("schema_hash", F.when(hashed, place)).alias("last_hash"),
    ).select("source", "probes", "passed", "changes", "first_hash", "last_hash", "day")


def store_days(daily: DataFrame, path: str) -> None:
    """Replaces the stored days that are in the frame and leaves the others."""
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stats_of_days(daily: DataFrame, *, as_of: str) -> DataFrame:
    """history_stats and the schema changes of 30 days for a date, from the daily rows of those days alone.

    A source without probes in them has no row.
    """
    now, day = F.lit(as_of).cast("date"), F.col("day")
    in7 = day >= F.date_sub(now, 7)
    days = daily.filter(day >= F.date_sub(now, 30))
    # A month has at most one row per day and source, so a source's rows make a small window.
    last = F.last("last_hash", ignorenulls=True).over(
        Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("_between", F.coalesce((last != F.col("first_hash")).cast("int"), F.lit(0)))
    g = days.groupBy("source").agg(
        F.coalesce(F.sum(F.when(in7, F.col("probes"))), F.lit(0)).alias("probes_7d"), F.sum("probes").alias("probes_30d"),
        F.coalesce(F.sum(F.when(in7, F.col("passed"))), F.lit(0)).alias("_ok7"), F.sum("passed").alias("_ok30"),
        F.sum(F.col("changes") + F.col("_between")).alias("schema_changes_30d"))

    def rate(ok: str, n: str) -> Column:
        return numbers.half_up_to(numbers.ratio(F.col(ok), F.col(n)), 3)

    return g.select("source", rate("_ok7", "probes_7d").alias("success_rate_7d"),
                    rate("_ok30", "probes_30d").alias("success_rate_30d"),
                    "probes_7d", "probes_30d", "schema_changes_30d")


def fleet_metrics(state: DataFrame) -> DataFrame:
    """One row over all sources: totals by status, latency order statistics, drift, categories.

    The state has one row per source and is read several times, so it is written once.
    """
    state = cut(state.select("category", "status", "fresh", "schema_changes_30d", "success_rate_30d",
                             "latency_ms"), "fleet")
    verified = F.col("status") == "verified"
    counts = state.agg(
        F.count("*").alias("sources"), F.count_if(verified).alias("verified"),
        F.count_if(F.col("status").isNotNull() & ~verified).alias("failing"),
        F.count_if(F.col("status").isNull()).alias("never_verified"),
        F.count_if(F.col("status").isNotNull() & ~F.col("fresh")).alias("stale"),
        F.count_if(F.col("schema_changes_30d") > 0).alias("drifted"),
        numbers.half_up_to(F.avg("success_rate_30d"), 3).alias("mean_success_30d"),
    )
    categories = state.select("category").distinct().agg(F.count("category").alias("c"))
    latency = nth_smallest(state.filter(verified), "latency_ms",
                           {"median_latency": 0.5, "p95_latency": 0.95})
    return counts.withColumns({
        "categories": categories.scalar(),
        "median_latency": latency.select("median_latency").scalar(),
        "p95_latency": latency.select("p95_latency").scalar(),
    })


def sweep_summary(results: DataFrame, sweep: str) -> DataFrame:
    return results.groupBy(sweep).agg(
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count("*").alias("total"),
    )


def detection_scorecard(cases: DataFrame) -> DataFrame:
    """Cases (expected, actual, dimension_flagged) to detection, false alarms and pass."""
    injected = F.col("expected") != "verified"
    caught = injected & (F.col("actual") != "verified")
    g = cases.agg(
        F.count_if(injected).alias("injected"), F.count_if(caught).alias("detected"),
        F.count_if(~injected).alias("controls"),
        F.count_if(~injected & (F.col("actual") != "verified")).alias("false_positives"),
        F.count_if(injected & F.col("dimension_flagged")).alias("classified"),
    )
    return g.withColumn(
        "pass", (F.col("detected") == F.col("injected")) & (F.col("false_positives") == 0)
        & (F.col("classified") == F.col("injected")))


def ingest_outcome(runs: DataFrame) -> DataFrame:
    good = F.col("status").isin("OK", "OK_WITH_WARNINGS")
    loaded = numbers.int_or_zero(F.col("records_loaded"))
    return runs.agg(
        F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"),
        (F.count_if(good) == 0).alias("all_failed"), F.sum(loaded).alias("rows_loaded"))


# ------------------------------------------------------------------ sessions
def session_stats(events: DataFrame, *, order: list[str], session: str = "sessionId") -> DataFrame:
    """Created, modified, deleted and hottest branch (first seen among equals) per session."""
    kind = F.col("eventType")
    totals = events.groupBy(session).agg(
        F.count_if(kind == "add").alias("created"),
        F.count_if(kind == "change").alias("modified"),
        F.count_if(kind == "unlink").alias("deleted"), F.count("*").alias("total_events"))
    files = events.filter(~kind.isin("addDir", "unlinkDir"))
    hot = mode_first_tie(files, [session], "branchPath", order).select(
        session, F.col("branchPath").alias("hottest_branch"), F.col("n").alias("hottest_count"))
    return totals.join(hot, session, "left").fillna({"hottest_count": 0})


def dedupe_last_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Last row of each key along the order."""
    return pick_row(rows.withColumn("_key", key), ["_key"], order, last=True).drop("_key")


def distinct_inputs(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select(text.normalize_mark(F.col(mark)).alias("N_NUMBER")).filter(
        F.col("N_NUMBER") != "").distinct()


def evidence_count(findings: DataFrame, entity: str) -> DataFrame:
    return findings.groupBy(entity).agg(F.sum("EVIDENCE_COUNT").alias("EVIDENCE_COUNT"))


def severity_rollup(nodes: DataFrame) -> DataFrame:
    """Health of every node of a path tree (columns session, path, own: 0 green, 1 yellow, 2 red,
    has_badges). A node with badges shows its own; one without takes the worst below it.

    A node's health therefore comes from the nearest badged nodes under it. Leaves are first
    reduced to their folder, then each badge-bearing node or leaf climbs its ancestors up to the
    first badged one; no level-by-level loop is needed.
    """
    n = nodes.select("session", "path", "own", "has_badges")
    # worst colour each folder receives directly from its children
    direct = n.filter(F.col("path") != ".").groupBy(
        "session", text.dirname(F.col("path")).alias("folder")).agg(F.max("own").alias("worst"))
    badged = n.filter("has_badges").select(
        F.col("session").alias("_s"), F.col("path").alias("_p"), F.lit(True).alias("_b"))
    up = F.reverse(F.concat(F.array(F.lit(".")), text.ancestors(F.col("folder")),
                            F.when(F.col("folder") != ".", F.array("folder"))
                            .otherwise(F.array().cast("array<string>"))))
    climb = direct.select("session", "folder", "worst", F.posexplode(up).alias("level", "anc"))
    climb = climb.join(badged, (climb["session"] == badged["_s"]) & (climb["anc"] == badged["_p"]),
                       "left")
    # stops of a climb: the lowest badged ancestor (at most one path deep, so a short window)
    w = Window.partitionBy("session", "folder")
    climb = climb.withColumn("_stop", F.min(F.when(F.col("_b"), F.col("level"))).over(w))
    reach = climb.filter(F.col("_stop").isNull() | (F.col("level") < F.col("_stop")))
    below = reach.groupBy("session", F.col("anc").alias("path")).agg(F.max("worst").alias("below"))
    out = n.join(below, ["session", "path"], "left")
    level = F.when(F.col("has_badges"), F.col("own")).otherwise(F.coalesce("below", F.lit(0)))
    return out.select(
        "session", "path",
        F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), level + 1).alias("health"),
        F.element_at(F.array(F.lit("healthy"), F.lit("messy"), F.lit("review")), level + 1).alias("status"),
    )
