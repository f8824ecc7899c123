"""Ordered analytics, rankings and set operations on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.aggregates import GAP_SQL, LIVE_SQL, STATE_SQL
from recordlens.bindings.expressions import sql_list
from recordlens.functions import fixed, text
from recordlens.operators import matching, ranking, sequences
from recordlens.plans import quality
from recordlens.views import EVENTS_AS_OF, ORDERS_AS_OF

c = F.col
ORDER = ["ts", "event_id"]
EVENT_ORDER = ["timestamp", "event_id"]


@query(f"WITH {GAP_SQL} SELECT entity, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1",
       views=("v_flights",))
def longest_gap(t: Tables):
    return sequences.longest_gap(t.v_flights, ["SEQ"]).select(
        c("ENTITY").alias("entity"), "longest_gap")


@query(f"""
WITH {GAP_SQL}
SELECT entity, ds AS last_date, origin, dest, gap AS gap_before,
       coalesce(gap >= 120, false) AND origin <> dest AS repositioned FROM g WHERE back = 1
""", views=("v_flights",))
def last_move_after_gap(t: Tables):
    return sequences.last_move_after_gap(t.v_flights, ["SEQ"]).withColumnRenamed("ENTITY", "entity")


@query(f"WITH {STATE_SQL} SELECT source, schema_changes_30d FROM state", views=("v_history",))
def schema_changes(t: Tables):
    return sequences.schema_changes(t.v_history, ORDER, as_of=EVENTS_AS_OF)


@query(f"""
WITH {STATE_SQL}, n AS (SELECT source, count(*) AS probes FROM v_history GROUP BY 1)
SELECT source, streak, probes FROM state JOIN n USING (source)
""", views=("v_history",))
def verified_streak(t: Tables):
    return sequences.verified_streak(t.v_history, ORDER)


RUNS_SQL = """
  e AS (SELECT *, lag(eventType) OVER w AS pt, lag(branchPath) OVER w AS pb, lag(timestamp) OVER w AS pts
        FROM v_files WINDOW w AS (PARTITION BY sessionId ORDER BY timestamp, event_id)),
  f AS (SELECT *, sum(CASE WHEN pt = eventType AND pb = branchPath
          AND epoch_ms(timestamp) - epoch_ms(pts) < 7200000 THEN 0 ELSE 1 END)
          OVER (PARTITION BY sessionId ORDER BY timestamp, event_id) AS run FROM e),
  r AS (SELECT *, count(*) OVER (PARTITION BY sessionId, run) AS run_count,
          row_number() OVER (PARTITION BY sessionId, run ORDER BY timestamp DESC, event_id DESC) AS back FROM f)
"""
RUNS_SELECT = """
SELECT sessionId, event_id, eventType, branchPath, run_count >= 3 AS grouped,
       CASE WHEN run_count >= 3 THEN run_count ELSE 1 END AS count
FROM r WHERE run_count < 3 OR back = 1
"""


@query(f"WITH {RUNS_SQL} {RUNS_SELECT}", views=("v_files",))
def group_runs(t: Tables):
    return sequences.group_runs(t.v_files, EVENT_ORDER, gap_ms=7_200_000).select(
        "sessionId", "event_id", "eventType", "branchPath", "grouped", "count")


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY 1
""")
def latest_per_key(t: Tables):
    return sequences.latest_per_key(t.events, ["user_id"], ORDER).select(
        "user_id", "event_id", "event_type")


@query("""
WITH f AS (SELECT o_custkey AS entity, o_orderkey, o_orderpriority,
  CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 1 END AS sev FROM orders)
SELECT entity, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY entity ORDER BY sev, o_orderkey) AS rank
FROM f WHERE sev < 2 QUALIFY rank <= 5
""")
def top_n_findings(t: Tables):
    p = c("o_orderpriority")
    sev = F.when(p.startswith("1"), "priority").when(p.startswith("5"), "info").otherwise("review")
    rows = t.orders.select(c("o_custkey").alias("entity"), "o_orderkey", "o_orderpriority")
    return sequences.top_n_findings(
        rows, "entity", text.lookup(sev, fixed.SEVERITY_RANK, F.lit(9)), [F.asc("o_orderkey")])


@query("""
WITH w AS (SELECT source, doc_id, unnest(ws) AS theme, generate_subscripts(ws, 1) AS pos FROM (
  SELECT source, doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)
  AS ws FROM documents)),
n AS (SELECT source, theme, count(*) AS n, min((doc_id, pos)) AS f FROM w GROUP BY ALL)
SELECT source, theme, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS rank
FROM n QUALIFY rank <= 5
""")
def top_themes(t: Tables):
    return sequences.top_themes(
        t.documents, "source", text.task_tokens(c("text")), ["doc_id"]).select(
        "source", c("THEME").alias("theme"), "n", "rank")


@query("""
SELECT source, event_id, status, p AS from_status FROM (
  SELECT *, lag(status) OVER (PARTITION BY source ORDER BY ts, event_id) AS p FROM v_history)
WHERE p IS DISTINCT FROM status
""", views=("v_history",))
def status_changes(t: Tables):
    return sequences.status_changes(t.v_history, ORDER).select(
        "source", "event_id", "status", "from_status")


@query("""
SELECT source, event_id, schema_hash, p AS previous_hash FROM (
  SELECT *, lag(schema_hash) OVER (PARTITION BY source ORDER BY ts, event_id) AS p FROM v_history)
WHERE p <> schema_hash
""", views=("v_history",))
def drift_events(t: Tables):
    return sequences.drift_events(t.v_history, ORDER).select(
        "source", "event_id", "schema_hash", "previous_hash")


@query("""
WITH r AS (SELECT *, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(timestamp) AS age FROM v_files),
f AS (SELECT filePath AS path, count(*) AS edits, min(age) AS age, min((timestamp, event_id)) AS seen
      FROM r WHERE age < 259200000000 GROUP BY 1),
l AS (SELECT path, CASE WHEN edits >= 8 THEN 'thrashing' WHEN age < 86400000000 THEN 'active'
      ELSE 'recent' END AS level, edits, seen FROM f),
up AS (SELECT split_part(path, '/', 1) AS folder, level, seen FROM l
       UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), level, seen FROM l)
SELECT path, level, edits FROM l UNION ALL
SELECT folder, CASE WHEN arg_min(level, seen) = 'thrashing' THEN 'thrashing' ELSE 'branch-active' END, 0
FROM up GROUP BY folder
""", views=("v_files",))
def thrashing(t: Tables):
    return sequences.thrashing(t.v_files, EVENT_ORDER, as_of=EVENTS_AS_OF, window_s=3 * 86400,
                               active_s=86400, edits=8)


@query("""
SELECT year(o_orderdate) AS year, o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1
""")
def first_per_group(t: Tables):
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey", "o_custkey")
    return sequences.first_per_group(rows, ["year"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


OWNER_SQL = f"""
  oc AS (SELECT "N_NUMBER" AS entity, count(*) AS history_rows,
    count(*) FILTER (date_diff('day', CAST("DATE" AS DATE), DATE '{ORDERS_AS_OF}') <= 1825) AS changes_5yr,
    count(*) FILTER (contains("EVENT", 'cancel')) AS cancellations,
    max("DATE") AS last_change,
    date_diff('day', CAST(max("DATE") AS DATE), DATE '{ORDERS_AS_OF}') AS last_change_age
    FROM v_owner_history GROUP BY 1)
"""


@query(f"WITH {OWNER_SQL} SELECT * FROM oc", views=("v_owner_history",))
def recent_event_counts(t: Tables):
    return sequences.recent_event_counts(
        t.v_owner_history, ["SEQ"], as_of=ORDERS_AS_OF).withColumnRenamed("ENTITY", "entity")


# ------------------------------------------------------------------ rankings
@query("""
SELECT c_name, c_acctbal AS score FROM customer WHERE c_mktsegment <> 'FURNITURE'
ORDER BY c_acctbal DESC, c_name LIMIT 20
""")
def priority_board(t: Tables):
    rows = t.customer.select("c_name", c("c_acctbal").alias("score"), F.when(
        c("c_mktsegment") == "FURNITURE", "no").otherwise("yes").alias("RESOLVED"))
    return ranking.priority_board(rows, "score", "c_name").drop("RESOLVED")


CATALOG_SQL = STATE_SQL + """,
  cand AS (SELECT source AS capability_id, source % 3 <> 0 AS eligible, source % 5 AS match_score,
     event_id AS receipt_id, status, fresh, success_rate_30d, latency_ms, ts, streak, confidence,
     source % 4 = 0 AS experimental FROM state),
  ranked AS (SELECT *, row_number() OVER (ORDER BY (eligible AND status = 'verified' AND fresh) DESC,
     eligible DESC, coalesce(success_rate_30d, -1) DESC, match_score DESC, latency_ms NULLS LAST,
     capability_id) AS place FROM cand)
"""


def candidates(t: Tables):
    """Sources of the history as search candidates with state, eligibility and match score."""
    s = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF)
    return s.withColumns({
        "capability_id": c("source"), "eligible": c("source") % 3 != 0,
        "match_score": c("source") % 5, "receipt_id": c("event_id"),
        "experimental": c("source") % 4 == 0})


@query(f"""
WITH {CATALOG_SQL}
SELECT capability_id, eligible, status, fresh, success_rate_30d, match_score FROM ranked WHERE place <= 10
""", views=("v_history",))
def rank_sources(t: Tables):
    return ranking.rank_sources(candidates(t)).select(
        "capability_id", "eligible", "status", "fresh", "success_rate_30d", "match_score")


TASK = "Find the hand and other current data for the onthe"
TASK_WORDS = text.query_tokens(TASK)


def hits_sql(field: str, weight: int) -> str:
    words = f"string_split_regex(lower({field}), '[^a-z0-9]+')"
    return f"{weight} * len(list_filter({sql_list(TASK_WORDS)}, lambda w: list_contains({words}, w)))"


@query(f"""
SELECT * FROM (SELECT doc_id, {hits_sql('text', 3)} + {hits_sql("lang || ' ' || source", 2)} AS match_score
               FROM documents) WHERE match_score > 0
""")
def token_match_score(t: Tables):
    fields = {"text": (c("text"), 3), "tags": (F.concat_ws(" ", "lang", "source"), 2)}
    return ranking.token_match_score(t.documents, fields, TASK_WORDS).select("doc_id", "match_score")


@query("""
SELECT event_id, event_type FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10'
  ORDER BY ts DESC, event_id DESC LIMIT 50)
""")
def last_n_events(t: Tables):
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return ranking.last_n_events(t.events, ORDER, since=since).select("event_id", "event_type")


@query("""
WITH dec AS (SELECT s_name AS id, 'Supplier#' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS cand,
               0 AS tier, 0 AS pos FROM supplier
             UNION ALL SELECT s_name, 'Supplier#000000002', 0, 1 FROM supplier
             UNION ALL SELECT s.s_name, b.s_name, 1, b.rk FROM supplier s JOIN
               (SELECT s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS rk FROM supplier
                QUALIFY rk <= 10) b ON true),
o AS (SELECT id, cand, min((tier, pos)) AS spot FROM dec WHERE id <> cand GROUP BY 1, 2)
SELECT id AS capability_id, cand AS candidate, row_number() OVER (PARTITION BY id ORDER BY spot, cand) AS rank
FROM o QUALIFY rank <= 3
""")
def fallback_top3(t: Tables):
    name = F.concat(F.lit("Supplier#"), F.lpad((c("s_suppkey") + 1).cast("string"), 9, "0"))
    one = lambda x, tier, pos: F.struct(
        x.alias("candidate"), F.lit(tier).alias("tier"), F.lit(pos).cast("bigint").alias("pos"))
    # the ranked search result is a top ten, so it fits one array
    top = t.supplier.orderBy(F.desc("s_acctbal"), "s_name").limit(10).select("s_acctbal", "s_name")
    ranked = top.agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-c("s_acctbal")).alias("o"), "s_name"))),
        lambda x, i: F.struct(x["s_name"].alias("candidate"), F.lit(1).alias("tier"),
                              (i + 1).cast("bigint").alias("pos"))).alias("r"))
    both = F.concat(F.array(one(name, 0, 0), one(F.lit("Supplier#000000002"), 0, 1)), ranked.scalar())
    rows = t.supplier.select(c("s_name").alias("capability_id"), F.explode(both).alias("x")).select(
        "capability_id", "x.*")
    return ranking.fallback_top3(rows, "capability_id", ["tier", "pos"])


# ------------------------------------------------------------------ sets
@query("""
SELECT DISTINCT entity, airport FROM (SELECT "N_NUMBER" AS entity, "ORIGIN" AS airport FROM v_flights
  UNION ALL SELECT "N_NUMBER", "DEST" FROM v_flights)
""", views=("v_flights",))
def airport_set(t: Tables):
    return matching.airport_sets(t.v_flights).select(
        c("ENTITY").alias("entity"), c("AIRPORT").alias("airport"))


@query("""
SELECT DISTINCT l_suppkey AS suppkey, l_linenumber AS line FROM lineitem
EXCEPT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
""")
def missing_items(t: Tables):
    rows = lambda df: df.select(
        c("l_suppkey").alias("suppkey"), c("l_linenumber").alias("line"))
    done = t.lineitem.filter((c("l_returnflag") == "R") & (c("l_quantity") > 45))
    return ranking.missing_items(rows(t.lineitem), rows(done))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(upper(p_name), ' '),
  lambda x: x IN ('RED', 'RING', 'SMALL', 'BOLT')))), ' ') AS shared FROM part
""")
def token_intersection(t: Tables):
    wanted = F.array(*[F.lit(x) for x in ("RED", "RING", "SMALL", "BOLT")])
    return ranking.token_intersection(t.part, text.name_tokens(c("p_name")), wanted).select(
        "p_partkey", F.array_join("shared", " ").alias("shared"))


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders
""")
def union_all_sources(t: Tables):
    even = t.orders.filter(c("o_orderkey") % 2 == 0).select(
        "o_orderkey", "o_custkey", c("o_orderstatus").alias("status"))
    odd = t.orders.filter(c("o_orderkey") % 2 == 1).select("o_custkey", "o_orderkey")
    return ranking.union_all_sources([even, odd])
