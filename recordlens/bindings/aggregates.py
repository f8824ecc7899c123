"""Grouped summaries on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.expressions import sql_case, sql_chapter
from recordlens.functions import fixed, text
from recordlens.operators import aggregates, matching, sequences
from recordlens.plans import activity, quality
from recordlens.session import scratch_path
from recordlens.views import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF

c = F.col
ORDER = ["ts", "event_id"]
EVENT_ORDER = ["timestamp", "event_id"]


@query(f"""
WITH n AS (SELECT "N_NUMBER" AS entity, {sql_chapter('"JASC_CODE"')} AS chapter, count(*) AS n
           FROM v_reports GROUP BY ALL HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, chapter) AS rank FROM n QUALIFY rank <= 4
""", views=("v_reports",))
def chapter_themes(t: Tables):
    return aggregates.chapter_themes(t.v_reports, "N_NUMBER").select(
        c("N_NUMBER").alias("entity"), c("CHAPTER").alias("chapter"), "n", "rank")


@query(f"""
SELECT "MFR" AS mfr, "MODEL" AS model, {sql_chapter('"JASC_CODE"')} AS chapter, count(*) AS reports,
       count(*) FILTER (date_diff('day', CAST("DATE" AS DATE), DATE '{LINEITEM_AS_OF}') <= 1095) AS recent
FROM v_reports GROUP BY ALL
""", views=("v_reports",))
def model_patterns(t: Tables):
    return aggregates.model_patterns(t.v_reports, as_of=LINEITEM_AS_OF).select(
        c("MFR").alias("mfr"), c("MODEL").alias("model"), c("JASC_CHAPTER").alias("chapter"),
        c("REPORT_COUNT").alias("reports"), c("RECENT_COUNT").alias("recent"))


@query("""
SELECT o_custkey AS respondent, count(*) AS actions,
       count(*) FILTER (o_orderstatus = 'O') AS certificate,
       count(*) FILTER (o_orderstatus = 'P' OR o_orderkey % 10 = 0) AS penalties
FROM orders GROUP BY 1
""")
def entity_rollup(t: Tables):
    rows = t.orders.select(
        c("o_custkey").alias("RESPONDENT"),
        F.when(c("o_orderstatus") == "O", "Suspension").when(c("o_orderstatus") == "P", "civil_penalty")
        .otherwise("warning").alias("ACTION"),
        F.when(c("o_orderkey") % 10 == 0, "$1").otherwise("").alias("AMOUNT"))
    return aggregates.entity_rollup(rows).select(
        c("RESPONDENT").alias("respondent"), c("ACTION_COUNT").alias("actions"),
        c("CERTIFICATE_ACTIONS").alias("certificate"), c("CIVIL_PENALTY_COUNT").alias("penalties"))


@query("""
SELECT w AS theme, count(*) AS n FROM (
  SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents)
WHERE length(w) > 2 GROUP BY 1
""")
def theme_counts(t: Tables):
    return aggregates.theme_counts(t.documents, text.task_tokens(c("text"))).select(
        c("THEME").alias("theme"), c("REPORT_COUNT").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1")
def category_counts(t: Tables):
    return aggregates.category_counts(t.part, "p_type")


@query("""
SELECT upper(o_orderpriority) AS o_orderpriority, count(*) AS n FROM orders
WHERE o_orderkey % 11 = 0 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') BETWEEN 0 AND 730
GROUP BY 1
""")
def counts_within_years(t: Tables):
    d = F.when(c("o_orderkey") % 11 != 0, c("o_orderdate").cast("date"))
    return aggregates.counts_within_years(
        t.orders, "o_orderpriority", d, years=2, as_of="2000-01-01")


@query(f"""
SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS n,
       count(*) FILTER (l_returnflag = 'R') AS n_subset FROM lineitem
WHERE date_diff('day', CAST(l_shipdate AS DATE), DATE '{LINEITEM_AS_OF}') BETWEEN 0 AND 1825 GROUP BY 1
""")
def counts_with_subset(t: Tables):
    return aggregates.counts_within_years(
        t.lineitem, "l_suppkey", c("l_shipdate").cast("date"), years=5, as_of=LINEITEM_AS_OF,
        subset=c("l_returnflag") == "R")


CUT = f"strftime(DATE '{ORDERS_AS_OF}' - INTERVAL 24 MONTH, '%Y%m%d')"


def iso(x: str) -> str:
    return f"substr({x}, 1, 4) || '-' || substr({x}, 5, 2) || '-' || substr({x}, 7, 2)"


CRASH_SQL = f"""
SELECT dot_number, count(*) AS lifetime_total, count(DISTINCT crash_id) AS lifetime_distinct,
  {iso('min(report_date)')} AS first_date, {iso('max(report_date)')} AS last_date,
  count(*) FILTER (report_date >= {CUT}) AS recent_total,
  coalesce(sum(CASE WHEN fatalities = '' THEN 0 ELSE CAST(fatalities AS INT) END)
    FILTER (report_date >= {CUT}), 0)::BIGINT AS recent_fatal,
  coalesce(sum(CAST(injuries AS INT)) FILTER (report_date >= {CUT}), 0)::BIGINT AS recent_injuries,
  count(*) FILTER (report_date >= {CUT} AND regexp_matches(tow_away, '(?i)^y|1|t')) AS recent_tow_away
FROM v_crashes GROUP BY dot_number
"""


@query(CRASH_SQL, views=("v_crashes",))
def crash_summary(t: Tables):
    return aggregates.crash_summary(t.v_crashes, as_of=ORDERS_AS_OF)


def inspection_sql(as_of: str) -> str:
    cut = f"strftime(DATE '{as_of}' - INTERVAL 24 MONTH, '%Y%m%d')"
    return f"""
SELECT dot_number, count(*) AS file_total, {iso('min(insp_date)')} AS window_start,
  {iso('max(insp_date)')} AS window_end, count(*) FILTER (insp_date >= {cut}) AS recent_total,
  count(*) FILTER (insp_date >= {cut} AND vehicle_oos_total = '2') AS recent_vehicle_oos,
  count(*) FILTER (insp_date >= {cut} AND driver_oos_total = '1') AS recent_driver_oos,
  count(*) FILTER (insp_date >= {cut} AND viol_total <> '0') AS recent_with_violation,
  CASE WHEN recent_total > 0 THEN floor(recent_vehicle_oos / recent_total * 1000 + 0.5) / 10 END AS vehicle_oos_pct,
  CASE WHEN recent_total > 0 THEN floor(recent_driver_oos / recent_total * 1000 + 0.5) / 10 END AS driver_oos_pct
FROM v_inspections GROUP BY dot_number
"""


@query(inspection_sql(LINEITEM_AS_OF), views=("v_inspections",))
def inspection_rates(t: Tables):
    return aggregates.inspection_rates(t.v_inspections, as_of=LINEITEM_AS_OF)


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1),
r AS (SELECT c_custkey, o_custkey IS NOT NULL AS res, coalesce(n, 0) AS n, coalesce(f, 0) AS f
      FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT count(*) AS submitted, count(*) FILTER (res) AS resolved, count(*) FILTER (res) AS scored,
       count(*) FILTER (res AND n > 0) AS with_evidence, count(*) FILTER (res AND f > 0) AS with_direct_signal,
       count(*) > 0 AND count(*) = count(*) FILTER (res) AS gate_pass FROM r
""")
def batch_coverage(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("f"))
    r = t.customer.join(o, c("c_custkey") == c("o_custkey"), "left").select(
        F.when(c("o_custkey").isNotNull(), "yes").otherwise("no").alias("RESOLVED"),
        c("n").alias("EVIDENCE_COUNT"), c("f").alias("SDR_TAIL_SCORE"),
        F.lit(0).alias("NTSB_DIRECT_EVENT_SCORE"))
    return aggregates.batch_coverage(r)


GAP_SQL = """
  g AS (SELECT "N_NUMBER" AS entity, "SEQ" AS seq, CAST("DATE" AS DATE) AS d, "DATE" AS ds,
      "ORIGIN" AS origin, "DEST" AS dest, CAST("DURATION_MIN" AS DOUBLE) AS minutes,
      date_diff('day', lag(CAST("DATE" AS DATE)) OVER w, CAST("DATE" AS DATE)) AS gap,
      row_number() OVER (PARTITION BY "N_NUMBER" ORDER BY "DATE" DESC, "SEQ" DESC) AS back
    FROM v_flights WINDOW w AS (PARTITION BY "N_NUMBER" ORDER BY "DATE", "SEQ"))
"""


@query(f"""
WITH {GAP_SQL}
SELECT entity, count(*) AS flights, count(*) FILTER (origin = dest) AS local, sum(minutes) AS minutes,
  count(*) FILTER (date_diff('day', d, DATE '{ORDERS_AS_OF}') BETWEEN 0 AND 90) AS recent_90,
  count(*) FILTER (date_diff('day', d, DATE '{ORDERS_AS_OF}') BETWEEN 0 AND 365) AS recent_365,
  CAST(max(d) AS VARCHAR) AS last_date, coalesce(max(gap), 0) AS longest_gap,
  floor(count(*) FILTER (origin = dest) / count(*) * 1000000 + 0.5) / 1000000 AS local_share
FROM g GROUP BY entity
""", views=("v_flights",))
def activity_profile(t: Tables):
    p = aggregates.activity_profile(
        sequences.with_flight_gap(t.v_flights, ["SEQ"]), as_of=ORDERS_AS_OF)
    return p.select(c("ENTITY").alias("entity"), "flights", "local", "minutes", "recent_90",
                    "recent_365", c("last_date").cast("string").alias("last_date"), "longest_gap",
                    (F.floor(c("local_share") * 1000000 + 0.5) / 1000000).alias("local_share"))


@query("""
WITH n AS (SELECT "N_NUMBER" AS entity, "ORIGIN" AS home, count(*) AS n, min(("DATE", "SEQ")) AS f
           FROM v_flights GROUP BY ALL)
SELECT entity, home, n FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, f) = 1
""", views=("v_flights",))
def mode_first_tie(t: Tables):
    return aggregates.mode_first_tie(t.v_flights, ["N_NUMBER"], "ORIGIN", ["DATE", "SEQ"]).select(
        c("N_NUMBER").alias("entity"), c("ORIGIN").alias("home"), "n")


MODULE_OF = ("CASE l_linenumber WHEN 1 THEN 'registration' WHEN 2 THEN 'maintenance' "
             "WHEN 3 THEN 'accidents' WHEN 4 THEN 'adExposure' WHEN 5 THEN 'utilisation' "
             "WHEN 6 THEN 'enforcement' ELSE 'other' END")


def _module_rows(t: Tables):
    return t.lineitem.selectExpr("l_suppkey AS ENTITY", f"{MODULE_OF} AS MODULE", "l_quantity").groupBy(
        "ENTITY", "MODULE").agg(F.floor(F.sum("l_quantity") % 101).alias("SCORE"))


MODULE_ROWS_SQL = f"""
  m AS (SELECT l_suppkey AS entity, {MODULE_OF} AS module, floor(sum(l_quantity) % 101) AS score
        FROM lineitem GROUP BY ALL),
  w AS (SELECT *, CAST({sql_case('module', fixed.MODULE_WEIGHTS, 'NULL')} AS INT) AS weight FROM m)
"""


@query(f"""
WITH {MODULE_ROWS_SQL}
SELECT entity, CAST(floor(sum(weight * score) / sum(weight) + 0.5) AS INT) AS score
FROM w WHERE weight IS NOT NULL GROUP BY entity
""")
def composite_score(t: Tables):
    return aggregates.composite_score(_module_rows(t)).select(
        c("ENTITY").alias("entity"), c("SCORE").alias("score"))


@query(f"""
WITH {MODULE_ROWS_SQL},
g AS (SELECT entity, count(*) FILTER (score >= 40) / count(*) AS share,
  CASE entity % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS identity
  FROM w GROUP BY entity)
SELECT entity, identity, CASE WHEN identity = 'none' THEN 'none'
  WHEN identity = 'high' AND share >= 0.6 THEN 'high'
  WHEN identity IN ('high', 'medium') AND share >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM g
""")
def report_confidence(t: Tables):
    k = c("ENTITY") % 4
    identity = (F.when(k == 0, "none").when(k == 1, "low").when(k == 2, "medium").otherwise("high"))
    g = _module_rows(t).groupBy("ENTITY").agg(
        F.count_if(c("SCORE") >= 40).alias("n"), F.count("*").alias("total"))
    g = g.withColumn("identity", identity)
    return g.select(c("ENTITY").alias("entity"), "identity", aggregates.report_confidence(
        c("identity"), c("n"), c("total")).alias("confidence"))


def _check_rows(t: Tables):
    dim = text.lookup(c("type"), fixed.CHECK_DIMENSION, F.lit("task"))
    kind = (F.when(c("o_orderkey") % 5 == 0, "status").when(c("o_orderkey") % 5 == 1, "min_rows")
            .when(c("o_orderkey") % 5 == 2, "value_range").when(c("o_orderkey") % 5 == 3, "field_pattern")
            .otherwise("freshness"))
    rows = F.when(kind == "min_rows", c("o_orderkey") % 20)
    return t.orders.select(
        c("o_custkey").alias("probe_id"), c("o_orderkey").alias("check_idx"), kind.alias("type"),
        (c("o_orderstatus") != "F").alias("ok"), (c("o_orderkey") % 7 != 0).alias("critical"),
        c("o_orderpriority").alias("detail"), rows.alias("rows_found"),
        F.when(rows.isNotNull(), F.lit(15).cast("bigint")).alias("rows_expected"),
    ).withColumn("dimension", dim)


@query("""
WITH r AS (SELECT o_custkey AS probe_id, o_orderkey AS idx, o_orderstatus <> 'F' AS ok,
  o_orderkey % 7 <> 0 AS critical, o_orderpriority AS detail,
  ['status', 'min_rows', 'value_range', 'field_pattern', 'freshness'][o_orderkey % 5 + 1] AS type,
  ['availability', 'completeness', 'schema', 'join_keys', 'freshness'][o_orderkey % 5 + 1] AS dim,
  CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 20 END AS found FROM orders)
SELECT probe_id, coalesce(bool_and(ok) FILTER (critical), true) AS task_success,
  coalesce(bool_and(ok) FILTER (dim = 'availability'), true) AS available,
  coalesce(bool_and(ok) FILTER (dim = 'schema'), true) AS schema_valid,
  coalesce(bool_and(ok) FILTER (dim = 'join_keys'), true) AS join_keys_valid,
  coalesce(bool_and(ok) FILTER (dim = 'freshness'), true) AS freshness_valid,
  count(*) FILTER (ok) AS checks_passed, count(*) AS checks_total,
  floor(CASE WHEN count(found) > 0 THEN least(1.0, (arg_min(found, idx) FILTER (found IS NOT NULL)) / 15)
        ELSE count(*) FILTER (ok) / count(*) END * 1000 + 0.5) / 1000 AS completeness_score,
  coalesce(string_agg(type || ' [' || dim || ']: ' || detail, ';' ORDER BY idx) FILTER (NOT ok), '') AS failures
FROM r GROUP BY probe_id
""")
def check_rollup(t: Tables):
    return aggregates.check_rollup(_check_rows(t)).withColumn(
        "failures", F.array_join("failures", ";"))


STATS_SQL = """
  st AS (SELECT source,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS p7, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS p30,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-24' AND task_success) AS k7,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND task_success) AS k30 FROM v_history GROUP BY 1),
  stats AS (SELECT source, CASE WHEN p7 > 0 THEN floor(k7 / p7 * 1000 + 0.5) / 1000 END AS success_rate_7d,
    CASE WHEN p30 > 0 THEN floor(k30 / p30 * 1000 + 0.5) / 1000 END AS success_rate_30d,
    p7 AS probes_7d, p30 AS probes_30d FROM st)
"""


@query(f"WITH {STATS_SQL} SELECT * FROM stats", views=("v_history",))
def history_stats(t: Tables):
    return aggregates.history_stats(t.v_history, as_of=EVENTS_AS_OF)


@query("""
WITH a AS (SELECT unnest([DATE '2024-01-15', DATE '2024-01-29', DATE '2024-01-31']) AS as_of),
h AS (SELECT as_of, v_history.* FROM v_history, a WHERE ts >= as_of - INTERVAL 30 DAY),
c AS (SELECT as_of, source, schema_hash, lag(schema_hash) OVER (PARTITION BY as_of, source ORDER BY ts, event_id) AS p
      FROM h WHERE schema_hash IS NOT NULL),
k AS (SELECT as_of, source, count(*) FILTER (p <> schema_hash) AS n FROM c GROUP BY ALL),
g AS (SELECT as_of, source, count(*) AS p30, count(*) FILTER (task_success) AS k30,
  count(*) FILTER (ts >= as_of - INTERVAL 7 DAY) AS p7, count(*) FILTER (ts >= as_of - INTERVAL 7 DAY AND task_success) AS k7
  FROM h GROUP BY ALL)
SELECT CAST(as_of AS VARCHAR) AS as_of, source, CASE WHEN p7 > 0 THEN floor(k7 / p7 * 1000 + 0.5) / 1000 END AS success_rate_7d,
  floor(k30 / p30 * 1000 + 0.5) / 1000 AS success_rate_30d, p7 AS probes_7d, p30 AS probes_30d,
  coalesce(n, 0) AS schema_changes_30d FROM g LEFT JOIN k USING (as_of, source)
""", views=("v_history",))
def history_stats_daily(t: Tables):
    """Days are stored as they come, the last ones again on their own; three dates are read from the same store."""
    path = scratch_path(t.spark, "days")
    day = c("ts").cast("timestamp").cast("date")
    late = day >= F.lit("2024-01-20").cast("date")
    aggregates.store_days(aggregates.daily_history(t.v_history, ORDER), path)
    aggregates.store_days(aggregates.daily_history(t.v_history.filter(late), ORDER), path)
    daily = t.spark.read.schema(aggregates.DAY_SCHEMA).parquet(path)
    out = [aggregates.stats_of_days(daily, as_of=d).select(F.lit(d).alias("as_of"), "*")
           for d in ("2024-01-15", "2024-01-29", "2024-01-31")]
    return out[0].unionByName(out[1]).unionByName(out[2])


STATE_SQL = STATS_SQL + """,
  lst AS (SELECT * FROM v_history QUALIFY row_number() OVER
          (PARTITION BY source ORDER BY ts DESC, event_id DESC) = 1),
  bad AS (SELECT source, max((ts, event_id)) FILTER (NOT task_success) AS b FROM v_history GROUP BY 1),
  strk AS (SELECT h.source, count(*) FILTER (b IS NULL OR (ts, event_id) > b) AS streak
           FROM v_history h JOIN bad USING (source) GROUP BY 1),
  steps AS (SELECT source, schema_hash, lag(schema_hash) OVER (PARTITION BY source ORDER BY ts, event_id) AS p
            FROM v_history WHERE schema_hash IS NOT NULL AND ts >= TIMESTAMP '2024-01-01'),
  chg AS (SELECT source, count(*) FILTER (p <> schema_hash) AS schema_changes_30d FROM steps GROUP BY 1),
  state AS (SELECT lst.source, event_id, ts, task_success, latency_ms, status,
    ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-31' AS fresh, checks_passed, checks_total,
    success_rate_7d, success_rate_30d, probes_7d, probes_30d, streak,
    coalesce(schema_changes_30d, 0) AS schema_changes_30d,
    floor((0.6 * checks_passed / checks_total + 0.4 * success_rate_30d) * 1000 + 0.5) / 1000 AS confidence
    FROM lst JOIN stats USING (source) JOIN strk USING (source) LEFT JOIN chg USING (source))
"""


@query(f"""
WITH {STATE_SQL},
lat AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n
        FROM state WHERE status = 'verified')
SELECT count(*) AS sources, count(*) FILTER (status = 'verified') AS verified,
  count(*) FILTER (status <> 'verified') AS failing, 0::BIGINT AS never_verified,
  count(*) FILTER (NOT fresh) AS stale, count(*) FILTER (schema_changes_30d > 0) AS drifted,
  floor(avg(success_rate_30d) * 1000 + 0.5) / 1000 AS mean_success_30d,
  count(DISTINCT source % 7) AS categories,
  (SELECT max(latency_ms) FROM lat WHERE i = n // 2) AS median_latency,
  (SELECT max(latency_ms) FROM lat WHERE i = CAST(floor(n * 0.95) AS BIGINT)) AS p95_latency FROM state
""", views=("v_history",))
def fleet_metrics(t: Tables):
    state = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF).withColumn(
        "category", c("source") % 7)
    return aggregates.fleet_metrics(state)


SESSION_SQL = """
  s AS (SELECT sessionId, count(*) FILTER (eventType = 'add') AS created,
    count(*) FILTER (eventType = 'change') AS modified, count(*) FILTER (eventType = 'unlink') AS deleted,
    count(*) AS total_events FROM v_files GROUP BY 1),
  b AS (SELECT sessionId, branchPath, count(*) AS n, min((timestamp, event_id)) AS f FROM v_files GROUP BY 1, 2),
  h AS (SELECT sessionId, branchPath AS hottest_branch, n AS hottest_count FROM b QUALIFY row_number() OVER
      (PARTITION BY sessionId ORDER BY n DESC, f) = 1),
  session_rows AS (SELECT * FROM s JOIN h USING (sessionId))
"""


@query(f"WITH {SESSION_SQL} SELECT * FROM session_rows", views=("v_files",))
def session_stats(t: Tables):
    return aggregates.session_stats(t.v_files, order=EVENT_ORDER)


LIVE_SQL = """
  live AS (SELECT * FROM (SELECT * FROM v_files QUALIFY row_number() OVER
    (PARTITION BY sessionId, filePath ORDER BY timestamp DESC, event_id DESC) = 1)
    WHERE eventType <> 'unlink'),
  sev AS (SELECT sessionId, filePath, branchPath, CASE WHEN lines > 500 OR imports > 25 THEN 2
     WHEN lines > 300 OR imports > 15 OR exports > 10 THEN 1 ELSE 0 END AS own FROM live),
  dirs AS (SELECT DISTINCT sessionId, p FROM (SELECT sessionId, branchPath AS p FROM live
     UNION ALL SELECT sessionId, split_part(branchPath, '/', 1) FROM live
     UNION ALL SELECT sessionId, '.' FROM live)),
  dirn AS (SELECT d.sessionId, p, count(filePath) AS files FROM dirs d LEFT JOIN live l
     ON l.sessionId = d.sessionId AND l.branchPath = p GROUP BY ALL),
  dbadge AS (SELECT sessionId, p, files, CASE WHEN files > 15 THEN 1 ELSE 0 END AS own FROM dirn)
"""


@query(f"""
WITH {LIVE_SQL},
leafdir AS (SELECT d.sessionId, p, CASE WHEN d.own > 0 THEN d.own ELSE coalesce(max(s.own), 0) END AS level
  FROM dbadge d LEFT JOIN sev s ON s.sessionId = d.sessionId AND s.branchPath = p
  WHERE contains(p, '/') GROUP BY d.sessionId, p, d.own),
topdir AS (SELECT d.sessionId, d.p, CASE WHEN d.own > 0 THEN d.own ELSE coalesce(max(l.level), 0) END AS level
  FROM dbadge d LEFT JOIN leafdir l ON l.sessionId = d.sessionId AND split_part(l.p, '/', 1) = d.p
  WHERE d.p <> '.' AND NOT contains(d.p, '/') GROUP BY d.sessionId, d.p, d.own),
rootdir AS (SELECT sessionId, '.' AS p, max(level) AS level FROM topdir GROUP BY 1),
every AS (SELECT sessionId, filePath AS p, own AS level FROM sev UNION ALL SELECT * FROM leafdir
  UNION ALL SELECT * FROM topdir UNION ALL SELECT * FROM rootdir)
SELECT sessionId AS session, p AS path, ['green', 'yellow', 'red'][level + 1] AS health,
       ['healthy', 'messy', 'review'][level + 1] AS status FROM every
""", views=("v_files",))
def severity_rollup(t: Tables):
    return activity.tree_health(activity.latest_state(t.v_files, EVENT_ORDER))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
""")
def dedupe_last_wins(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                             "l_extendedprice")
    out = aggregates.dedupe_last_wins(
        rows, F.struct("l_orderkey", "l_linenumber"),
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      c("l_shipdate").cast("date").cast("string").alias("shipped"))


@query("""
SELECT DISTINCT CASE WHEN starts_with(m, 'N') OR m = '' THEN m ELSE 'N' || m END AS "N_NUMBER"
FROM (SELECT regexp_replace(upper(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE
      CASE o_orderkey % 3 WHEN 0 THEN 'n ' ELSE '' END || o_custkey END), '[\\s-]', '', 'g') AS m FROM orders)
WHERE m <> ''
""")
def distinct_inputs(t: Tables):
    raw = F.when(c("o_orderkey") % 5 == 0, "").otherwise(F.concat(
        F.when(c("o_orderkey") % 3 == 0, "n ").otherwise(""), c("o_custkey").cast("string")))
    return aggregates.distinct_inputs(t.orders.select(raw.alias("mark")), "mark")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (status = 'verified') AS verified,
       0::BIGINT AS skipped, count(*) AS total FROM v_history GROUP BY 1
""", views=("v_history",))
def sweep_summary(t: Tables):
    days = t.v_history.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return aggregates.sweep_summary(days, "day")


@query("""
SELECT count(*) FILTER (event_type IN ('click', 'view')) AS ok,
       count(*) FILTER (event_type NOT IN ('click', 'view')) AS failed,
       count(*) FILTER (event_type IN ('click', 'view')) = 0 AS all_failed,
       sum(user_id)::BIGINT AS rows_loaded FROM events
""")
def ingest_outcome(t: Tables):
    runs = t.events.select(
        F.when(c("event_type") == "click", "OK").when(c("event_type") == "view", "OK_WITH_WARNINGS")
        .otherwise("BLOCKED").alias("status"),
        F.concat(c("user_id").cast("string"), F.lit(" rows")).alias("records_loaded"))
    return aggregates.ingest_outcome(runs)


@query("SELECT l_orderkey, sum(l_linenumber)::BIGINT AS evidence FROM lineitem GROUP BY 1")
def evidence_count(t: Tables):
    rows = t.lineitem.select("l_orderkey", c("l_linenumber").alias("EVIDENCE_COUNT"))
    return aggregates.evidence_count(rows, "l_orderkey").select(
        "l_orderkey", c("EVIDENCE_COUNT").alias("evidence"))
