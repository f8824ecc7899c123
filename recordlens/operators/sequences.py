"""Operators along an order: gaps, streaks, transitions, runs, latest and first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.functions import dates, text
from recordlens.operators.ordered import (
    date_chunk, pick_row, time_chunk, top_n, with_previous, with_running_total,
)


def with_flight_gap(flights: DataFrame, order: list[str]) -> DataFrame:
    """Flights with the days since the mark's flight before (NULL on the first)."""
    f = flights.withColumn("ENTITY", text.normalize_mark(F.col("N_NUMBER"))).withColumn(
        "_date", dates.as_date(F.col("DATE")))
    f = with_previous(f, ["ENTITY"], ["_date", *order], ["_date"], date_chunk(F.col("_date")))
    return f.withColumn("gap", F.datediff(F.col("_date"), F.col("prev._date")))


def longest_gap(flights: DataFrame, order: list[str]) -> DataFrame:
    return with_flight_gap(flights, order).groupBy("ENTITY").agg(
        F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def last_move_after_gap(flights: DataFrame, order: list[str], *, days: int = 120) -> DataFrame:
    """Last flight of each mark, the gap before it, and whether it was a one-way move after one."""
    f = with_flight_gap(flights, order)
    last = f.groupBy("ENTITY").agg(
        F.max_by(F.struct("DATE", "ORIGIN", "DEST", "gap"), F.struct("_date", *order)).alias("l"))
    return last.select(
        "ENTITY", F.col("l.DATE").alias("last_date"), F.col("l.ORIGIN").alias("origin"),
        F.col("l.DEST").alias("dest"), F.col("l.gap").alias("gap_before"),
        (F.coalesce(F.col("l.gap") >= days, F.lit(False)) & (F.col("l.ORIGIN") != F.col("l.DEST")))
        .alias("repositioned"))


def _hash_steps(history: DataFrame, order: list[str]) -> DataFrame:
    known = history.filter(F.col("schema_hash").isNotNull())
    return with_previous(known, ["source"], order, ["schema_hash"], time_chunk(F.col("ts")))


def schema_changes(history: DataFrame, order: list[str], *, as_of: str, days: int = 30) -> DataFrame:
    """Transitions between schema hashes per source in the window; probes without hash skipped."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    recent = history.filter(F.col("ts").cast("timestamp") >= start)
    steps = _hash_steps(recent, order)
    per_source = steps.groupBy("source").agg(
        F.count_if(F.col("prev").isNotNull() & (F.col("prev.schema_hash") != F.col("schema_hash")))
        .alias("schema_changes_30d"))
    everyone = history.select("source").distinct()
    return everyone.join(per_source, "source", "left").fillna({"schema_changes_30d": 0})


def verified_streak(history: DataFrame, order: list[str]) -> DataFrame:
    """Trailing run of successes per source: rows after its last failure, counted map-side."""
    at = F.struct(*order)
    last_bad = history.groupBy("source").agg(
        F.max(F.when(~F.col("task_success"), at)).alias("_bad"), F.count("*").alias("probes"))
    after = history.join(last_bad, "source").groupBy("source").agg(
        F.max("probes").alias("probes"),
        F.count_if(F.col("_bad").isNull() | (at > F.col("_bad"))).alias("streak"))
    return after.select("source", "streak", "probes")


def run_islands(events: DataFrame, order: list[str], *, gap_ms: int = 5000,
                session: str = "sessionId", weight: str | None = None,
                chunk_seconds: int = 3600) -> DataFrame:
    """Runs of the same type and branch, each event soon after the one before.

    One row per run: session, run number, run_count, and the first and last event as structs; a run
    of any length is merged as an aggregate. ``weight`` lets one row stand for several.
    """
    chunk = time_chunk(F.col("timestamp"), chunk_seconds)
    e = events.withColumn("_ms", dates.epoch_ms(F.col("timestamp")))
    e = with_previous(e, [session], order, ["eventType", "branchPath", "_ms"], chunk)
    joined_up = (F.col("prev").isNotNull()
                 & F.col("eventType").eqNullSafe(F.col("prev.eventType"))
                 & F.col("branchPath").eqNullSafe(F.col("prev.branchPath"))
                 & (F.col("_ms") - F.col("prev._ms") < gap_ms))
    e = e.withColumn("_new", F.when(joined_up, 0).otherwise(1)).drop("prev", "_ms")
    e = with_running_total(e, [session], order, F.col("_new"), "_run", chunk).drop("_new")
    row = F.struct(*[c for c in events.columns if c != weight])
    by = F.struct(*order)
    n = F.count("*") if weight is None else F.sum(weight)
    return e.groupBy(session, "_run").agg(
        n.alias("run_count"), F.min_by(row, by).alias("_first"), F.max_by(row, by).alias("_last"))


def show_runs(runs: DataFrame, columns: list[str], at_least: int = 3) -> DataFrame:
    """Long runs as their last event with the count; the events of short runs one by one."""
    shown = F.when(F.col("run_count") == 2, F.array("_first", "_last")).otherwise(F.array("_last"))
    out = runs.select("run_count", F.explode(shown).alias("r"))
    long = F.col("run_count") >= at_least
    return out.select(*[F.col("r")[c].alias(c) for c in columns], long.alias("grouped"),
                      F.when(long, F.col("run_count")).otherwise(1).alias("count"))


def group_runs(events: DataFrame, order: list[str], *, gap_ms: int = 5000,
               session: str = "sessionId") -> DataFrame:
    """Activity feed: runs of three or more collapse to their last event with the count."""
    return show_runs(run_islands(events, order, gap_ms=gap_ms, session=session), events.columns)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pick_row(rows, keys, order, last=True)


def top_n_findings(findings: DataFrame, entity: str, severity_rank: Column, order: list[Column],
                   n: int = 5) -> DataFrame:
    """Most severe findings per entity in stable order; informational ones are left out."""
    ranked = findings.withColumn("_rank", severity_rank).filter(F.col("_rank") < 2)
    return top_n(ranked, [entity], [F.asc("_rank"), *order], n).drop("_rank")


def top_themes(rows: DataFrame, entity: str, themes: Column, order: list[str], n: int = 5) -> DataFrame:
    """Most frequent themes per entity; among equals the one seen first."""
    long = rows.select(entity, *order, F.posexplode(themes).alias("_pos", "THEME"))
    counts = long.groupBy(entity, "THEME").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "_pos")).alias("_first"))
    return top_n(counts, [entity], [F.desc("n"), F.asc("_first")], n).drop("_first")


def status_changes(history: DataFrame, order: list[str]) -> DataFrame:
    """Probes whose status differs from the source's probe before; the first one counts."""
    h = with_previous(history, ["source"], order, ["status"], time_chunk(F.col("ts")))
    before = F.col("prev.status")
    return h.filter(~before.eqNullSafe(F.col("status"))).select(
        *history.columns, before.alias("from_status"))


def drift_events(history: DataFrame, order: list[str]) -> DataFrame:
    """Probes whose hash and the hash of the probe right before are both known and differ."""
    h = with_previous(history, ["source"], order, ["schema_hash"], time_chunk(F.col("ts")))
    before = F.col("prev.schema_hash")
    return h.filter(before.isNotNull() & (before != F.col("schema_hash"))).select(
        *history.columns, before.alias("previous_hash"))


def thrashing(events: DataFrame, order: list[str], *, as_of: str, window_s: int = 60,
              active_s: int = 20, edits: int = 3) -> DataFrame:
    """Activity level of recently touched paths and of the folders above them.

    A folder takes its mark from the path whose recent event came first. Events are reduced to one
    row per path before the folders are derived.
    """
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(
        F.col("timestamp").cast("timestamp"))
    recent = events.withColumn("_age", age).filter(F.col("_age") < window_s * 1_000_000)
    counted = ~F.col("eventType").isin("addDir", "unlinkDir")
    files = recent.groupBy("filePath").agg(
        F.count_if(counted).alias("_n"), F.min("_age").alias("_age"),
        F.min(F.struct(*order)).alias("_at"))
    files = files.withColumn("edits", F.when(F.col("_n") == 0, 1).otherwise(F.col("_n")))
    level = (F.when(F.col("edits") >= edits, "thrashing")
             .when(F.col("_age") < active_s * 1_000_000, "active").otherwise("recent"))
    files = files.select("filePath", level.alias("level"), "edits", "_at")
    above = files.select(F.explode(text.ancestors(F.col("filePath"))).alias("path"), "level", "_at")
    folders = above.groupBy("path").agg(F.min_by("level", "_at").alias("_l")).select(
        "path", F.when(F.col("_l") == "thrashing", "thrashing").otherwise("branch-active")
        .alias("level"), F.lit(0).cast("bigint").alias("edits"))
    return files.select(F.col("filePath").alias("path"), "level", "edits").unionByName(folders)


def first_per_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pick_row(rows, keys, order, last=False)


def recent_event_counts(history: DataFrame, order: list[str], *, as_of: str) -> DataFrame:
    """Ownership and registration changes per mark: last five years, last change, cancellations."""
    event = text.blank(F.col("EVENT"))
    owner = event.rlike(r"(?i)ownership|registration")
    age = dates.text_age_days(F.col("DATE"), as_of)
    last = F.max_by(F.when(owner, F.struct("DATE", "EVENT", age.alias("age"))),
                    F.when(owner, F.struct("DATE", *order)))
    return history.groupBy(text.normalize_mark(F.col("N_NUMBER")).alias("ENTITY")).agg(
        F.count("*").alias("history_rows"),
        F.count_if(owner & (age <= 5 * 365)).alias("changes_5yr"),
        F.count_if(event.rlike(r"(?i)cancel|deregist")).alias("cancellations"),
        last.alias("_last"),
    ).select("ENTITY", "history_rows", "changes_5yr", "cancellations",
             F.col("_last.DATE").alias("last_change"), F.col("_last.age").alias("last_change_age"))
