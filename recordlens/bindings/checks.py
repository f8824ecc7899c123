"""Quality checks, receipts, policies, routing and detection on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.aggregates import STATE_SQL
from recordlens.bindings.windows import CATALOG_SQL, candidates
from recordlens.functions import fixed, text
from recordlens.operators import aggregates
from recordlens.plans import quality
from recordlens.sources import feeds, ingest, store, tables
from recordlens.session import scratch_path
from recordlens.views import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF

c = F.col
ORDER = ["ts", "event_id"]
OUT = ["type", "dimension", "ok", "failed", "checked"]


def result_sql(key: str, kind: str, failed: str, checked: str, source: str, ok: str = "failed = 0") -> str:
    """Grouped counts as check rows."""
    head = f"{key}, " if key else ""
    group = "GROUP BY ALL" if key else ""
    return f"""SELECT {head.split(' AS ')[-1] if key else ''} '{kind}' AS type,
      '{fixed.CHECK_DIMENSION[kind]}' AS dimension, {ok} AS ok, failed, checked
      FROM (SELECT {head} {failed} AS failed, {checked} AS checked FROM {source} {group})"""


def one(df, check, key, as_of=EVENTS_AS_OF, **kw):
    r = quality.run_contract(df, [check], as_of=as_of, keys=[key] if key else [], **kw)
    return r.select(*([key] if key else []), *OUT)


@query(result_sql("user_id % 40 AS source", "status", "count(*) FILTER (event_type = 'error')",
                  "count(*)", "events"))
def check_status(t: Tables):
    df = t.events.select((c("user_id") % 40).alias("source"), F.when(
        c("event_type") == "error", 500).otherwise(200).alias("status"))
    return one(df, {"type": "status"}, "source")


@query(result_sql("user_id % 40 AS source", "json", "count(*) FILTER (event_id % 100 = 0)", "count(*)",
                  "events"))
def check_json(t: Tables):
    df = t.events.select((c("user_id") % 40).alias("source"), F.when(
        c("event_id") % 100 == 0, "<html>").otherwise(c("props")).alias("body"))
    return one(df, {"type": "json", "field": "body"}, "source")


@query(result_sql("user_id % 40 AS source", "max_latency",
                  "count(*) FILTER (event_id % 500 = 0 OR value > 60)", "count(*)", "events"))
def check_max_latency(t: Tables):
    df = t.events.select((c("user_id") % 40).alias("source"), F.when(
        c("event_id") % 500 != 0, c("value")).alias("latency"))
    return one(df, {"type": "max_latency", "field": "latency", "ms": 60}, "source")


@query(result_sql("o_custkey", "min_rows", "greatest(0, 10 - count(*))", "count(*)", "orders"))
def check_min_rows(t: Tables):
    return one(t.orders, {"type": "min_rows", "min": 10}, "o_custkey")


@query(result_sql("user_id % 40 AS source", "fields_present", "count(*) FILTER (event_id % 50 = 0)",
                  "count(*)", "events"))
def check_fields_present(t: Tables):
    body = (F.when(c("event_id") % 50 == 0, '{"j": 1}').when(c("event_id") % 50 == 1, '{"k": null}')
            .otherwise(c("props")))
    df = t.events.select((c("user_id") % 40).alias("source"), F.try_parse_json(body).alias("doc"))
    return one(df, {"type": "fields_present", "fields": ["k"]}, "source", json_col="doc")


@query(result_sql("c_nationkey", "field_pattern",
                  "count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{8}[1-9]$'))", "count(*)",
                  "customer"))
def check_field_pattern(t: Tables):
    return one(t.customer, {"type": "field_pattern", "field": "c_name",
                            "pattern": "^Customer#[0-9]{8}[1-9]$"}, "c_nationkey")


@query(result_sql("l_suppkey", "value_range",
                  "count(*) FILTER (l_quantity < 2 OR (l_quantity > 45 AND l_quantity <> 50))",
                  "count(*)", "lineitem"))
def check_value_range(t: Tables):
    return one(t.lineitem, {"type": "value_range", "field": "l_quantity", "min": 2, "max": 45,
                            "allow_values": ["50.0"]}, "l_suppkey", as_of=LINEITEM_AS_OF)


@query("""
SELECT 0 AS check_idx, (SELECT r_name = 'AFRICA' FROM region WHERE r_regionkey = 0) AS ok
UNION ALL SELECT 1, (SELECT contains(r_name, 'XX') FROM region WHERE r_regionkey = 1)
UNION ALL SELECT 2, (SELECT r_regionkey BETWEEN 1 AND 3 FROM region WHERE r_name = 'ASIA')
UNION ALL SELECT 3, true UNION ALL SELECT 4, (SELECT count(*) > 0 FROM region WHERE r_name = 'NOWHERE')
""")
def check_known_answer(t: Tables):
    ask = lambda where, field, **p: {"type": "known_answer", "where": where, "field": field, **p}
    return quality.run_contract(t.region, [
        ask("r_regionkey = 0", "r_name", equals="AFRICA"),
        ask("r_regionkey = 1", "r_name", contains="XX"),
        ask("r_name = 'ASIA'", "r_regionkey", min_number=1, max_number=3),
        ask("r_regionkey = 4", "r_name"), ask("r_name = 'NOWHERE'", "r_name")],
        as_of=EVENTS_AS_OF).select("check_idx", "ok")


@query("""
SELECT 'unique_field' AS type, 'completeness' AS dimension, failed = 0 AS ok, failed, checked FROM (
  SELECT count(*) FILTER (n > 1) AS failed, sum(n)::BIGINT AS checked
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
""")
def check_unique_field(t: Tables):
    df = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"))
    return one(df, {"type": "unique_field", "field": "line_key"}, None, as_of=LINEITEM_AS_OF)


@query(result_sql("user_id % 40 AS source", "freshness",
                  f"(max(ts) < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3 HOUR)::INT", "1", "events"))
def check_freshness(t: Tables):
    df = t.events.select((c("user_id") % 40).alias("source"), "ts")
    return one(df, {"type": "freshness", "field": "ts", "max_age_hours": 3}, "source")


ORDERS_CONTRACT = [
    {"type": "min_rows", "min": 100},
    {"type": "unique_field", "field": "o_orderkey"},
    {"type": "fields_present", "fields": ["o_orderkey", "o_comment"]},
    {"type": "field_pattern", "field": "o_orderpriority", "pattern": "^[1-5]-"},
    {"type": "value_range", "field": "o_totalprice", "min": 0, "max": 400000, "critical": False},
    {"type": "known_answer", "field": "o_orderstatus", "first_by": "o_orderkey", "equals": "P"},
    {"type": "freshness", "field": "o_orderdate", "max_age_hours": 24},
    {"type": "no_such_check"},
]


@query(f"""
WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d,
  count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-')) AS p,
  count(*) FILTER (o_totalprice NOT BETWEEN 0 AND 400000) AS r, arg_min(o_orderstatus, o_orderkey) AS s,
  date_diff('hour', max(o_orderdate), TIMESTAMP '{ORDERS_AS_OF}') <= 24 AS f FROM orders)
SELECT 0 AS check_idx, n >= 100 AS ok, 0::BIGINT AS failed, true AS critical FROM o
UNION ALL SELECT 1, n = d, n - d, true FROM o UNION ALL SELECT 2, false, n, true FROM o
UNION ALL SELECT 3, p = 0, p, true FROM o UNION ALL SELECT 4, r = 0, r, false FROM o
UNION ALL SELECT 5, s = 'P', (s <> 'P')::BIGINT, true FROM o
UNION ALL SELECT 6, f, (NOT f)::BIGINT, true FROM o UNION ALL SELECT 7, false, 0, true FROM o
""")
def run_contract(t: Tables):
    return quality.run_contract(t.orders, ORDERS_CONTRACT, as_of=ORDERS_AS_OF).select(
        "check_idx", "ok", "failed", "critical")


BODY = ("'{\"data\": {\"items\": [{\"id\": ' || event_id || ', \"v\": ' || (event_id % 90) || '}, {\"id\": ' "
        "|| (event_id + event_id % 2) || ', \"v\": \"-\"}]}, \"meta\": {\"title\": \"All ' || event_type || "
        "' rows\"}}'")
RESPONSE_CONTRACTS = {
    "cap0": [
        {"type": "status", "equals": 200}, {"type": "json"},
        {"type": "min_rows", "path": "data.items", "min": 2},
        {"type": "unique_field", "path": "data.items", "field": "id"},
        {"type": "value_range", "path": "data.items", "field": "v", "max": 50, "allow_values": ["-"]},
    ],
    "cap1": [
        {"type": "fields_present", "path": "data.items", "fields": ["id", "v"]},
        {"type": "field_pattern", "path": "data.items", "field": "id", "pattern": "[0-8]$"},
        {"type": "known_answer", "path": "meta.title", "contains": "click"},
        {"type": "known_answer", "path": "data.items.0.v", "min_number": 10},
    ],
}


@query("""
WITH r AS (SELECT event_id AS id, 'cap' || (event_id % 3) AS cap, event_type AS et,
   event_id % 20 <> 7 AS up, event_id % 20 <> 9 AS parsed FROM events),
x AS (SELECT *, up AND parsed AS good FROM r)
SELECT id AS probe_id, 0 AS check_idx, up AS ok FROM x WHERE cap = 'cap0'
UNION ALL SELECT id, 1, good FROM x WHERE cap = 'cap0' UNION ALL SELECT id, 2, good FROM x WHERE cap = 'cap0'
UNION ALL SELECT id, 3, good AND id % 2 <> 0 FROM x WHERE cap = 'cap0'
UNION ALL SELECT id, 4, good AND id % 90 <= 50 FROM x WHERE cap = 'cap0'
UNION ALL SELECT id, 0, good FROM x WHERE cap = 'cap1'
UNION ALL SELECT id, 1, good AND id % 10 <> 9 AND (id + id % 2) % 10 <> 9 FROM x WHERE cap = 'cap1'
UNION ALL SELECT id, 2, good AND et = 'click' FROM x WHERE cap = 'cap1'
UNION ALL SELECT id, 3, good AND id % 90 >= 10 FROM x WHERE cap = 'cap1'
""")
def response_checks(t: Tables):
    up = c("event_id") % 20 != 7
    body = F.when(c("event_id") % 20 == 9, "<html>").otherwise(F.expr(BODY))
    r = t.events.select(
        F.concat(F.lit("cap"), (c("event_id") % 3).cast("string")).alias("capability_id"),
        c("event_id").alias("probe_id"), F.when(up, 200).alias("status"),
        F.when(up, body).alias("body_text"), c("value").alias("latency_ms"),
        F.when(~up, "timeout").alias("error"))
    return quality.check_responses(r, RESPONSE_CONTRACTS, as_of=EVENTS_AS_OF).select(
        "probe_id", "check_idx", "ok")


@query("""
SELECT event_id, CASE WHEN task_success THEN 'verified' WHEN event_id % 5 = 0 THEN 'unreachable'
       ELSE 'failed_checks' END AS status,
       strftime(ts + INTERVAL (4 + source % 3) HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM v_history
""", views=("v_history",))
def receipt_status(t: Tables):
    probes = t.v_history.withColumns({
        "verified_at": c("ts").cast("timestamp"), "ttl_hours": 4 + c("source") % 3,
        "error": F.when(c("event_id") % 5 == 0, "timeout")})
    return quality.receipt_status(probes).select(
        "event_id", "status", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("""
SELECT source, count(*) AS fresh FROM v_history
WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1
""", views=("v_history",))
def receipt_fresh(t: Tables):
    r = quality.receipts_of(t.v_history)
    return r.filter(quality.receipt_fresh("2024-01-30 12:00:00")).groupBy("source").agg(
        F.count("*").alias("fresh"))


REASONS_SQL = """list_filter([
   CASE WHEN status <> 'verified' THEN 'status ' || status END, CASE WHEN NOT fresh THEN 'receipt expired' END,
   CASE WHEN max_age IS NOT NULL AND (epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 60000 > max_age
        THEN 'receipt too old' END,
   CASE WHEN NOT allow AND experimental THEN 'experimental' END,
   CASE WHEN streak < min_passes THEN 'streak too short' END,
   CASE WHEN success_rate_30d < min_rate THEN 'success rate too low' END,
   CASE WHEN confidence < min_conf THEN 'confidence too low' END], lambda x: x IS NOT NULL)"""
POLICY_SQL = """
  pol(policy, max_age, min_passes, min_rate, min_conf, allow) AS (VALUES ('production', 1440, 3, 0.9, 0.9, false),
    ('standard', 2880, 1, NULL, 0.75, true), ('permissive', NULL, NULL, NULL, NULL, true),
    ('custom', NULL, 2, 0.5, 0.6, true))"""
CUSTOM_POLICY = {"minimum_consecutive_passes": 2, "minimum_success_rate_30d": 0.5, "minimum_confidence": 0.6}


@query(f"""
WITH {CATALOG_SQL}, {POLICY_SQL}
SELECT capability_id, policy, array_to_string({REASONS_SQL}, ';') AS reasons,
       len({REASONS_SQL}) = 0 AS allowed, confidence FROM cand, pol
""", views=("v_history",))
def policy_gate(t: Tables):
    policies = {**fixed.POLICIES, "custom": CUSTOM_POLICY}
    return quality.policy_gate(candidates(t), policies, as_of=EVENTS_AS_OF).select(
        "capability_id", "policy", F.array_join("reasons", ";").alias("reasons"), "allowed", "confidence")


@query(f"""
WITH {CATALOG_SQL}, {POLICY_SQL},
top AS (SELECT * FROM ranked WHERE eligible),
g AS (SELECT top.*, len({REASONS_SQL}) = 0 AS allowed, array_to_string({REASONS_SQL}, ';') AS reasons
      FROM top, pol WHERE policy = 'standard'),
n AS (SELECT *, row_number() OVER (PARTITION BY allowed ORDER BY confidence DESC, place) AS pos FROM g)
SELECT capability_id, confidence, reasons, CASE WHEN allowed AND pos <= 4 THEN pos END AS position,
  CASE WHEN NOT allowed THEN 'rejected' WHEN pos = 1 THEN 'approved' WHEN pos <= 4 THEN 'fallback'
       ELSE 'not needed' END AS decision FROM n
""", views=("v_history",))
def resolve_best(t: Tables):
    return quality.resolve_best(candidates(t), "standard", as_of=EVENTS_AS_OF).select(
        "capability_id", "confidence", F.array_join("reasons", ";").alias("reasons"), "position",
        "decision")


@query(f"""
WITH {CATALOG_SQL},
top AS (SELECT * FROM ranked WHERE eligible),
best AS (SELECT * FROM top WHERE status = 'verified' AND fresh ORDER BY place LIMIT 1),
fb AS (SELECT id, min(o) AS o FROM (
    SELECT (capability_id + 1) % 40 AS id, 0 AS o FROM best UNION ALL SELECT capability_id, place FROM top)
  WHERE id <> (SELECT capability_id FROM best) GROUP BY id ORDER BY o LIMIT 3)
SELECT capability_id, receipt_id, success_rate_30d,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY o) FROM fb) AS fallbacks FROM best
""", views=("v_history",))
def route_best(t: Tables):
    cand = candidates(t).withColumn("capability_id", c("capability_id").cast("string"))
    # ranks compare ids as numbers, so pad them for the text order
    cand = cand.withColumn("capability_id", F.lpad("capability_id", 3, "0"))
    catalog = cand.select("capability_id", F.array(F.lpad(
        ((c("source") + 1) % 40).cast("string"), 3, "0")).alias("fallback_ids"))
    unpad = lambda x: x.cast("int")
    return quality.route_best(cand, catalog).select(
        unpad(c("capability_id")).alias("capability_id"), "receipt_id", "success_rate_30d",
        F.array_join(F.transform("fallbacks", lambda x: unpad(x).cast("string")), ",").alias("fallbacks"))


@query(f"""
WITH {STATE_SQL}
SELECT s.source AS capability_id, CASE WHEN status IS NULL THEN 'never verified'
  WHEN status = 'verified' THEN 'latest probe succeeded' ELSE 'responded but failed checks' END AS explanation
FROM (SELECT DISTINCT user_id % 45 AS source FROM events) s LEFT JOIN state ON state.source = s.source
""", views=("v_history",))
def explain_failure(t: Tables):
    every = t.events.select((c("user_id") % 45).alias("source")).distinct()
    state = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF)
    return quality.explain_failure(every.join(state, "source", "left")).select(
        c("source").alias("capability_id"), "explanation")


@query(f"""
WITH {STATE_SQL}
SELECT s.source AS capability_id, event_id AS receipt_id, status, fresh
FROM (SELECT DISTINCT user_id % 45 AS source FROM events) s LEFT JOIN state ON state.source = s.source
""", views=("v_history",))
def capability_list(t: Tables):
    catalog = t.events.select((c("user_id") % 45).alias("capability_id")).distinct()
    latest = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF).withColumnsRenamed(
        {"source": "capability_id", "event_id": "receipt_id"})
    return quality.capability_list(catalog, latest).select(
        "capability_id", "receipt_id", "status", "fresh")


@query(f"WITH {STATE_SQL} SELECT source, streak, streak >= 3 AS ready FROM state", views=("v_history",))
def promotion_gate(t: Tables):
    state = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF)
    return quality.promotion_gate(state).select("source", "streak", "ready")


@query("""
WITH x(src, n, f) AS (SELECT 'orders', count(*), 'o_orderkey,o_custkey,o_totalprice,o_orderpriority' FROM orders
  UNION ALL SELECT 'customer', count(*), 'c_custkey,c_name,c_nationkey,c_acctbal' FROM customer)
SELECT src, 0 AS check_idx, 'status' AS type, '200' AS parameter FROM x UNION ALL
SELECT src, 1, 'json', '' FROM x UNION ALL SELECT src, 2, 'max_latency', '20000' FROM x UNION ALL
SELECT src, 3, 'min_rows', CAST(greatest(1, n // 2) AS VARCHAR) FROM x UNION ALL
SELECT src, 4, 'fields_present', f FROM x
""")
def draft_contract(t: Tables):
    orders = t.orders.withColumn("o_orderstatus", F.when(c("o_orderstatus") != "P", c("o_orderstatus")))
    a = quality.draft_contract(orders).withColumn("src", F.lit("orders"))
    b = quality.draft_contract(t.customer).withColumn("src", F.lit("customer"))
    return a.unionByName(b).select("src", "check_idx", "type", "parameter")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'data.rows' ELSE 'items' END AS path,
       CASE WHEN event_id % 4 = 0 THEN 3 ELSE 2 END AS size FROM events
""")
def find_row_array(t: Tables):
    body = F.when(c("event_id") % 4 == 0, F.expr(
        "'{\"items\": [1, 2], \"data\": {\"rows\": [1, 2, ' || event_id || '], \"x\": {\"y\": {\"z\": [1,2,3,4,5]}}}}'")
    ).otherwise(F.expr("'{\"items\": [1, ' || event_id || '], \"data\": {\"b\": [5]}}'"))
    return quality.find_row_array(t.events.select("event_id", body.alias("body")), "event_id", "body")


@query("""
SELECT count(*) AS rows, CASE WHEN count(*) = 0 THEN 'ZERO_ROWS' ELSE 'VALIDATION_FAILED' END
       AS status, 'none' AS confidence, 'p_comment' AS missing_columns, 'part' AS src FROM part
UNION ALL SELECT count(*), CASE WHEN count(*) < 1000 THEN 'OK_WITH_WARNINGS' ELSE 'OK' END,
       CASE WHEN count(*) < 1000 THEN 'medium' ELSE 'high' END, '', 'supplier' FROM supplier
""")
def ingest_validation(t: Tables):
    a = quality.ingest_validation(t.part, ["p_partkey", "p_comment"]).withColumn("src", F.lit("part"))
    b = quality.ingest_validation(t.supplier, ["s_suppkey"]).withColumn("src", F.lit("supplier"))
    return a.unionByName(b)


@query("""
SELECT count(*) FILTER (n_regionkey < 3) AS network_sources,
       count(*) FILTER (n_regionkey < 3 AND n_nationkey % 6 <> 5) AS ok_sources,
       count(*) FILTER (n_regionkey < 3 AND n_nationkey % 6 = 5) = 0 AS ready FROM nation
""")
def readiness(t: Tables):
    rows = t.nation.select(
        F.when(c("n_regionkey") < 3, "network").otherwise("offline").alias("kind"),
        F.when(c("n_nationkey") % 6 == 5, "BLOCKED").otherwise("REACHABLE_SHAPE_OK").alias("status"))
    return quality.readiness(rows)


# Every nation's customers are one case; its number modulo six says what is wrong with them.
FAULTS = {1: "schema", 2: "schema", 3: "completeness", 4: "join_keys", 5: "completeness"}
FAULTY_SQL = """
f AS (SELECT c_nationkey AS case_id, c_nationkey % 6 AS fault, c_custkey AS k, c_custkey % 2 = 0 AS hit,
             c_name AS name, c_acctbal AS balance FROM customer),
r AS (SELECT case_id, fault, k, CASE WHEN fault = 4 AND hit THEN 'none' ELSE name END AS name,
             CASE WHEN fault = 1 AND hit THEN balance + 1000000 WHEN fault = 2 AND hit THEN balance - 1000000
                  ELSE balance END AS balance FROM f WHERE NOT (fault = 5 AND k > 3)
      UNION ALL SELECT case_id, fault, k, name, balance FROM f WHERE fault = 3 AND hit),
t AS (SELECT case_id, fault, count(*) < 2 AS few, count(DISTINCT k) < count(*) AS twice,
             min(balance) < -10000 OR max(balance) > 100000 AS wild,
             bool_or(NOT regexp_matches(name, '^Customer#')) AS odd FROM r GROUP BY ALL),
outcome AS (SELECT case_id, CASE WHEN fault = 0 THEN 'verified' ELSE 'failed_checks' END AS expected,
  CASE WHEN few OR twice OR wild OR odd THEN 'failed_checks' ELSE 'verified' END AS actual,
  CASE fault WHEN 1 THEN 'schema' WHEN 2 THEN 'schema' WHEN 3 THEN 'completeness' WHEN 4 THEN 'join_keys'
       WHEN 5 THEN 'completeness' END AS dimension_expected,
  CASE WHEN fault IN (1, 2) THEN wild WHEN fault IN (3, 5) THEN few OR twice WHEN fault = 4 THEN odd
       ELSE false END AS dimension_flagged FROM t)"""


def _outcomes(t: Tables):
    fault, hit, balance = c("fault"), c("hit"), c("c_acctbal")
    base = t.customer.withColumns({
        "case_id": c("c_nationkey"), "fault": c("c_nationkey") % 6, "hit": c("c_custkey") % 2 == 0})
    changed = base.filter(~((fault == 5) & (c("c_custkey") > 3))).select(
        "case_id", c("c_custkey").alias("k"), F.when((fault == 4) & hit, "none").otherwise(c("c_name")).alias("name"),
        F.when((fault == 1) & hit, balance + 1000000).when((fault == 2) & hit, balance - 1000000)
        .otherwise(balance).alias("balance"))
    again = base.filter((fault == 3) & hit).select(
        "case_id", c("c_custkey").alias("k"), c("c_name").alias("name"), balance.alias("balance"))
    checks = quality.run_contract(changed.unionByName(again), [
        {"type": "min_rows", "min": 2}, {"type": "unique_field", "field": "k"},
        {"type": "value_range", "field": "balance", "min": -10000, "max": 100000},
        {"type": "field_pattern", "field": "name", "pattern": "^Customer#"},
    ], as_of=EVENTS_AS_OF, keys=["case_id"]).withColumnRenamed("dimension", "check_dimension")
    wanted = base.select("case_id", text.lookup(fault.cast("string"), {
        str(k): v for k, v in FAULTS.items()}).alias("dimension")).distinct()
    return quality.case_outcomes(checks, wanted)


@query(f"WITH {FAULTY_SQL} SELECT * FROM outcome")
def inject_failures(t: Tables):
    return _outcomes(t)


@query(f"""
WITH {FAULTY_SQL}, s AS (SELECT count(*) FILTER (expected <> 'verified') AS injected,
  count(*) FILTER (expected <> 'verified' AND actual <> 'verified') AS detected,
  count(*) FILTER (expected = 'verified') AS controls,
  count(*) FILTER (expected = 'verified' AND actual <> 'verified') AS false_positives,
  count(*) FILTER (expected <> 'verified' AND dimension_flagged) AS classified FROM outcome)
SELECT *, detected = injected AND false_positives = 0 AND classified = injected AS pass FROM s
""")
def detection_scorecard(t: Tables):
    return aggregates.detection_scorecard(_outcomes(t))


@query(f"""
WITH {CATALOG_SQL}, {POLICY_SQL},
top AS (SELECT * FROM ranked WHERE capability_id BETWEEN 3 AND 17),
g AS (SELECT top.*, len({REASONS_SQL}) = 0 AS allowed FROM top, pol WHERE policy = 'standard'),
n AS (SELECT *, row_number() OVER (PARTITION BY allowed ORDER BY confidence DESC, place) AS pos FROM g)
SELECT capability_id, CASE WHEN allowed AND pos <= 4 THEN pos END AS position,
  CASE WHEN NOT allowed THEN 'rejected' WHEN pos = 1 THEN 'approved' WHEN pos <= 4 THEN 'fallback'
       ELSE 'not needed' END AS decision FROM n
""", views=("v_history",))
def resolve_capability(t: Tables):
    cand = candidates(t)
    catalog = cand.select("capability_id", F.transform(
        F.sequence(F.lit(1), F.lit(14)), lambda k: c("capability_id") + k).alias("fallback_ids"))
    return quality.resolve_capability(cand, catalog, 3, as_of=EVENTS_AS_OF).select(
        "capability_id", "position", "decision")


@query("""
SELECT * FROM (SELECT 'enforcement' AS source_name, 'OK' AS status,
  CAST(2 * (SELECT count(*) FROM supplier) + (SELECT count(DISTINCT "RESPONDENT") FROM v_enforcement) AS VARCHAR)
  AS records_loaded
  UNION ALL SELECT 'asrs', 'ZERO_ROWS', '' UNION ALL SELECT 'strikes', 'VALIDATION_FAILED', ''
  UNION ALL SELECT 'unheard-of', 'SOURCE_UNAVAILABLE', '')
""", views=("v_enforcement",))
def run_isolation(t: Tables):
    spark = t.spark
    base = scratch_path(spark, "ingest")
    tables.csv_sink(t.v_enforcement, feeds.ENFORCEMENT, f"{base}/in/enforcement")
    tables.csv_sink(t.v_enforcement, ["CASE_ID", "SUMMARY"], f"{base}/in/strikes")
    ingest.run_ingest(
        spark, {n: f"{base}/in/{n}" for n in ("strikes", "unheard-of", "asrs", "enforcement")},
        f"{base}/db", as_of=ORDERS_AS_OF)
    return store.read_health(spark, f"{base}/db").select("source_name", "status", "records_loaded")


@query("""
SELECT 'sdr' AS source_name, 'OK_WITH_WARNINGS' AS status, 'medium' AS confidence,
  CAST(count(*) * 2 + 2 AS VARCHAR) AS records_loaded,
  'no column for DATE, MFR, MODEL; the file is left out | no registry yet; matches left out' AS warnings FROM supplier
""")
def ingest_warnings(t: Tables):
    spark = t.spark
    base = scratch_path(spark, "ingest")
    rows = t.supplier.select(
        c("s_suppkey").cast("string").alias("SDR No"), F.lit("2019-01-01").alias("Difficulty Date"),
        F.concat(F.lit("N"), c("s_suppkey")).alias("Registration Number"), c("s_name").alias("ACFT MAKE"),
        F.lit("M1").alias("Model"))
    for name, part in (("sdr_2019", rows), ("sdr_2020", rows.toDF("a", "b", "c", "d", "e"))):
        tables.csv_sink(part, part.columns, f"{base}/in/{name}.csv")
    ingest.run_ingest(spark, {"sdr": f"{base}/in"}, f"{base}/db", as_of=ORDERS_AS_OF)
    warnings = F.regexp_replace("error_message", r"^sdr_2020\.csv: ", "")
    return store.read_health(spark, f"{base}/db").select(
        "source_name", "status", "confidence", "records_loaded", warnings.alias("warnings"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS now
  FROM events GROUP BY ALL),
p AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d)
SELECT CAST(user_id AS VARCHAR) || '@' || CAST(day AS VARCHAR) AS "table", before AS previous, now AS current
FROM p WHERE before <> now
""")
def table_schema_drift(t: Tables):
    """Every user's events are a table whose columns are the types seen; each day against the one before."""
    cells = t.events.select(c("user_id").cast("string").alias("user"), c("ts").cast("date").alias("on"), "event_type")
    daily = quality.daily_columns(cells, "user", "on", "event_type")
    named = lambda df: df.select(
        F.concat("table", F.lit("@"), c("day").cast("string")).alias("table"), "columns")
    return quality.table_schema_drift(named(daily), named(quality.saved_before(daily))).select(
        "table", F.array_join("previous", ",").alias("previous"), F.array_join("current", ",").alias("current"))
