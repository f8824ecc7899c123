"""Session activity in batch and as streams that run over the events in three arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.aggregates import LIVE_SQL, SESSION_SQL, STATE_SQL
from recordlens.bindings.windows import RUNS_SELECT, RUNS_SQL
from recordlens.plans import activity
from recordlens.session import scratch_path, stream_session
from recordlens.sources import feeds
from recordlens.streaming import carry, jobs

c = F.col
ORDER = ["timestamp", "event_id"]
HISTORY_ORDER = ["ts", "event_id"]


def live(t: Tables):
    return activity.latest_state(t.v_files, ORDER)


def badge_text(badges):
    return F.array_join(F.transform(badges, lambda b: F.concat_ws(":", b["id"], b["severity"], b["value"])), ";")


LATEST = f"WITH {LIVE_SQL} SELECT sessionId, filePath, event_id, eventType FROM live"
BADGES_SQL = """array_to_string(list_filter([
  CASE WHEN lines > 500 THEN 'oversized:red:' || lines WHEN lines > 300 THEN 'oversized:yellow:' || lines END,
  CASE WHEN imports > 25 THEN 'importHeavy:red:' || imports WHEN imports > 15 THEN 'importHeavy:yellow:' || imports END,
  CASE WHEN exports > 10 THEN 'highSurfaceArea:yellow:' || exports END], lambda x: x IS NOT NULL), ';')"""


@query(LATEST, views=("v_files",))
def latest_state(t: Tables):
    return live(t).select("sessionId", "filePath", "event_id", "eventType")


@query(f"SELECT event_id, {BADGES_SQL} AS badges FROM v_files", views=("v_files",))
def file_badges(t: Tables):
    return activity.file_badges(t.v_files).select("event_id", badge_text(c("badges")).alias("badges"))


@query(f"""
WITH {LIVE_SQL} SELECT sessionId, p AS path, files,
  CASE WHEN files > 15 THEN 'flatDump:yellow:' || files ELSE '' END AS badges FROM dbadge
""", views=("v_files",))
def branch_badges(t: Tables):
    return activity.branch_badges(live(t)).select("sessionId", "path", "files",
                                                  badge_text(c("badges")).alias("badges"))


TREE_SQL = f"""{LIVE_SQL},
  node AS (SELECT sessionId, filePath AS path, branchPath AS parent, 'file' AS kind, {BADGES_SQL} AS badges FROM live
   UNION ALL SELECT sessionId, p, CASE WHEN p = '.' THEN NULL WHEN contains(p, '/') THEN split_part(p, '/', 1)
     ELSE '.' END, 'dir', CASE WHEN files > 15 THEN 'flatDump:yellow:' || files ELSE '' END FROM dbadge)"""


@query(f"""
WITH {TREE_SQL}
SELECT sessionId, path, parent, kind, badges, CASE WHEN path = '.' THEN 'root' ELSE string_split(path, '/')[-1] END
  AS name FROM node
""", views=("v_files",))
def build_tree(t: Tables):
    return activity.build_tree(live(t)).select(
        "sessionId", "path", "parent", "kind", badge_text(c("badges")).alias("badges"), "name")


@query(f"""
WITH {TREE_SQL}
SELECT n.sessionId, n.path, n.badges, count(k.path) AS children FROM node n LEFT JOIN node k
  ON k.sessionId = n.sessionId AND k.parent = n.path GROUP BY ALL
""", views=("v_files",))
def node_health(t: Tables):
    return activity.node_health(live(t)).select(
        "sessionId", "path", badge_text(c("badges")).alias("badges"), "children")


@query("""
SELECT event_id, CASE WHEN lines <= 300 AND imports <= 15 AND exports <= 10 THEN 'continue'
  WHEN (lines > 500 OR imports > 25) AND (lines > 300)::INT + (imports > 15)::INT + (exports > 10)::INT >= 2
    THEN 'secondOpinion'
  WHEN lines > 300 OR exports > 10 THEN 'splitFile' ELSE 'refactor' END AS action FROM v_files
""", views=("v_files",))
def suggested_action(t: Tables):
    return activity.file_badges(t.v_files).select(
        "event_id", activity.suggested_action(c("badges")).alias("action"))


@query(f"""
WITH {TREE_SQL}, {SESSION_SQL},
n AS (SELECT sessionId, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS folders,
      count(*) FILTER (badges <> '') AS badged FROM node GROUP BY 1)
SELECT * FROM session_rows JOIN n USING (sessionId)
""", views=("v_files",))
def session_snapshot(t: Tables):
    return activity.session_snapshot(t.v_files, ORDER)


# ------------------------------------------------------------------ streams
CUTS = [None, "2024-01-11", "2024-01-21", None]


def arrivals(t: Tables, view_name: str, time: str, start, base: str, close: str | None = None) -> None:
    """Writes the view in three time slices; after each one the stream runs until it has read it.

    With ``close``, one event that much after the last one follows; it moves the watermark past all windows,
    and its own window stays open.
    """
    own = stream_session(t.spark)
    df = getattr(t, view_name)
    ts = c(time).cast("timestamp")
    source = f"{base}/in"
    parts = []
    for i in range(3):
        part = df.withColumn(time, ts)
        if CUTS[i]:
            part = part.filter(ts >= CUTS[i])
        if CUTS[i + 1]:
            part = part.filter(ts < CUTS[i + 1])
        parts.append(part)
    if close:
        last = df.withColumn(time, ts).agg(F.max_by(F.struct(*df.columns), c(time)).alias("e")).select("e.*")
        parts.append(last.withColumn(time, c(time) + F.expr(f"INTERVAL {close}")))
    for i, part in enumerate(parts):
        part.write.parquet(f"{source}/part{i}")
        stream = own.readStream.schema(part.schema).parquet(f"{source}/*")
        start(stream).awaitTermination()


@query(LATEST, views=("v_files",))
def stream_latest_state(t: Tables):
    base = scratch_path(t.spark, "latest")
    arrivals(t, "v_files", "timestamp", lambda s: jobs.stream_latest_state(s, ORDER, base), base)
    return jobs.latest_state_now(t.spark, base).select("sessionId", "filePath", "event_id", "eventType")


@query(f"WITH {SESSION_SQL} SELECT * FROM session_rows", views=("v_files",))
def stream_session_stats(t: Tables):
    base = scratch_path(t.spark, "stats")
    arrivals(t, "v_files", "timestamp", lambda s: jobs.stream_session_stats(s, ORDER, base), base)
    return jobs.session_stats_now(t.spark, base)


def hourly_edits(t: Tables):
    """All hourly windows; a closing event lets the last ones out."""
    base = scratch_path(t.spark, "rate")
    arrivals(t, "v_files", "timestamp", lambda s: jobs.stream_edit_rate(s, base, window="1 hour"), base,
             close="2 HOURS")
    return t.spark.read.parquet(f"{base}/out").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "filePath", "edits", "thrashing")


HOURLY_SQL = """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, timestamp), '%Y-%m-%d %H:%M') AS hour, filePath, count(*) AS edits,
       count(*) >= 3 AS thrashing FROM v_files GROUP BY 1, 2
"""


@query(HOURLY_SQL, views=("v_files",))
def stream_edit_rate(t: Tables):
    """Every hourly window up to the last event."""
    return hourly_edits(t)


@query(HOURLY_SQL, views=("v_files",))
def stream_edit_rate_all(t: Tables):
    """The same under its earlier name."""
    return hourly_edits(t)


@query("""
SELECT filePath, event_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, count(*) OVER w AS edits,
       count(*) OVER w >= 3 AS thrashing
FROM v_files WHERE eventType NOT IN ('addDir', 'unlinkDir')
WINDOW w AS (PARTITION BY filePath ORDER BY epoch_us(timestamp::TIMESTAMP)
             RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
""", views=("v_files",))
def stream_recent_edits(t: Tables):
    """The edits of the six hours up to each edit; the events are too far apart for a minute."""
    base = scratch_path(t.spark, "recent")
    arrivals(t, "v_files", "timestamp", lambda s: jobs.stream_recent_edits(
        s, base, window_s=6 * 3600, span_s=5 * 86400), base, close="12 DAYS")
    return t.spark.read.parquet(f"{base}/out").select(
        "filePath", "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "edits", "thrashing")


@query(f"WITH {RUNS_SQL} {RUNS_SELECT}", views=("v_files",))
def stream_run_groups(t: Tables):
    base = scratch_path(t.spark, "runs")
    arrivals(t, "v_files", "timestamp",
             lambda s: jobs.stream_run_groups(s, ORDER, base, gap_ms=7_200_000), base)
    return jobs.run_groups_now(t.spark, base, t.v_files.columns).select(
        "sessionId", "event_id", "eventType", "branchPath", "grouped", "count")


@query("""
WITH h AS (SELECT *, lag(status) OVER w AS ps, lag(schema_hash) OVER w AS ph FROM v_history
  WINDOW w AS (PARTITION BY source ORDER BY ts, event_id))
SELECT source, event_id, 'status_changed' AS event, ps AS from_value, status AS to_value FROM h
WHERE ps IS DISTINCT FROM status
UNION ALL SELECT source, event_id, 'schema_drift', ph, schema_hash FROM h WHERE ph <> schema_hash
""", views=("v_history",))
def stream_status_events(t: Tables):
    base = scratch_path(t.spark, "alerts")
    arrivals(t, "v_history", "ts", lambda s: jobs.stream_status_events(s, HISTORY_ORDER, base), base)
    return carry.output(t.spark, base).select("source", "event_id", "event", "from_value", "to_value")


@query(f"WITH {STATE_SQL}, n AS (SELECT source, count(*) AS probes FROM v_history GROUP BY 1) "
       "SELECT source, streak, probes FROM state JOIN n USING (source)", views=("v_history",))
def stream_streak(t: Tables):
    base = scratch_path(t.spark, "streak")
    arrivals(t, "v_history", "ts", lambda s: jobs.stream_streak(s, HISTORY_ORDER, base), base)
    return carry.last_carry(t.spark, base, ["source"])


@query("SELECT 'N' || s_suppkey AS mark, s_name AS maker, s_nationkey::VARCHAR AS model FROM supplier")
def stream_ingest(t: Tables):
    """Three arrivals with different headers; the third repeats the second file's content."""
    base = scratch_path(t.spark, "feed")
    k = c("s_suppkey")
    day = F.lit("2024-01-01")
    first = t.supplier.filter(k % 2 == 0).coalesce(1).select(
        day.alias("Event Date"), k.alias("Registration No"), c("s_name").alias("Aircraft Make"),
        c("s_nationkey").alias("model"))
    second = t.supplier.filter(k % 2 == 1).coalesce(1).orderBy("s_suppkey").select(
        c("s_name").alias("MAKE"), c("s_nationkey").alias("ACFT_MODEL"), day.alias("DATE"),
        k.alias("N_NUMBER"))
    for i, df in enumerate((first, second, second)):
        df.write.option("header", True).csv(f"{base}/in/drop{i}")
        jobs.stream_ingest(t.spark, f"{base}/in/*/*.csv", feeds.SDR_HEADERS, feeds.SDR_ESSENTIAL,
                           base).awaitTermination()
    from recordlens.functions import text

    return jobs.ingested(t.spark, base).select(
        text.normalize_mark(c("N_NUMBER")).alias("mark"), c("MFR").alias("maker"), c("MODEL").alias("model"))


@query("""
SELECT sessionId, count(*) AS events, count(*) FILTER (eventType = 'add') AS added,
       sum(lines)::BIGINT AS lines FROM v_files GROUP BY 1
""", views=("v_files",))
def session_stream_source(t: Tables):
    """Session logs as JSON lines, read as a stream into a table."""
    base = scratch_path(t.spark, "log")
    t.v_files.select(
        "sessionId", F.unix_millis(c("timestamp").cast("timestamp")).alias("timestamp"), "eventType",
        "filePath", "branchPath",
        F.struct("lines", F.lit(0).cast("bigint").alias("sizeBytes"), "imports", "exports").alias("metadata"),
        F.array().cast("array<string>").alias("badges"), F.lit("").alias("diffSummaryHash"),
    ).write.json(f"{base}/in")
    stream = jobs.session_stream_source(t.spark, f"{base}/in")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("sessionId").agg(
        F.count("*").alias("events"), F.count_if(c("eventType") == "add").alias("added"),
        F.sum("lines").alias("lines"))
