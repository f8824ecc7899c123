"""Matching joins on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.expressions import sql_chapter, sql_list
from recordlens.functions import fixed, text
from recordlens.operators import matching
from recordlens.plans import quality
from recordlens.views import EVENTS_AS_OF, ORDERS_AS_OF

c = F.col
ORDER = ["ts", "event_id"]


def tokens_sql(name: str, stop: list[str], shortest: int) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(upper({name}), '[^A-Z0-9 ]', ' ', 'g'), "
            f"'\\s+'), lambda x: length(x) >= {shortest} AND NOT list_contains({sql_list(stop)}, x))")


def header_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""
SELECT f."N_NUMBER" AS mark, regexp_matches(f."N_NUMBER", '{fixed.MARK_PATTERN}') AS valid,
       r."N_NUMBER" IS NOT NULL AS resolved, r."MFR" AS mfr, count(*) AS n
FROM v_flights f LEFT JOIN v_registry r ON f."N_NUMBER" = r."N_NUMBER"
     AND regexp_matches(f."N_NUMBER", '{fixed.MARK_PATTERN}')
GROUP BY ALL
""", views=("v_flights", "v_registry"))
def registry_lookup(t: Tables):
    hit = matching.registry_lookup(t.v_flights, t.v_registry, order=["SERIAL_NUMBER", "MODEL"])
    return hit.groupBy(c("MARK").alias("mark"), c("VALID").alias("valid"),
                       c("RESOLVED").alias("resolved"), c("MFR").alias("mfr")).agg(
        F.count("*").alias("n"))


@query(f"""
WITH i AS (SELECT "N_NUMBER" AS mark, regexp_matches("N_NUMBER", '{fixed.MARK_PATTERN}') AS valid, *
           FROM v_registry),
g AS (SELECT mark, valid, list_filter([
    CASE WHEN NOT valid THEN 'invalid mark' END,
    CASE WHEN valid AND "SERIAL_NUMBER" = '' THEN 'missing serial' END,
    CASE WHEN valid AND upper("STATUS") <> 'VALID' THEN 'status not valid' END,
    CASE WHEN valid AND "EXPIRATION_DATE" < '{ORDERS_AS_OF}' THEN 'registration expired' END,
    CASE WHEN valid AND "MODE_S_HEX" = '' THEN 'no transponder code' END],
    lambda x: x IS NOT NULL) AS issues FROM i)
SELECT mark, array_to_string(issues, ';') AS issues, CASE WHEN NOT valid THEN 'none'
       WHEN len(issues) >= 2 THEN 'low' WHEN len(issues) = 1 THEN 'medium' ELSE 'high' END AS confidence
FROM g
""", views=("v_registry",))
def identity_confidence(t: Tables):
    hit = matching.registry_lookup(t.v_registry, t.v_registry, order=["SERIAL_NUMBER", "MODEL"])
    return matching.identity_confidence(hit, as_of=ORDERS_AS_OF).select(
        c("MARK").alias("mark"), F.array_join("ISSUES", ";").alias("issues"),
        c("IDENTITY_CONFIDENCE").alias("confidence"))


@query("""
SELECT h."N_NUMBER" AS entity, h."DATE" AS event_date, h."EVENT" AS event, h."SEQ" AS seq
FROM v_owner_history h JOIN v_registry r ON h."N_NUMBER" = r."N_NUMBER"
""", views=("v_owner_history", "v_registry"))
def tail_events(t: Tables):
    return matching.tail_events(t.v_registry, t.v_owner_history).select(
        c("ENTITY").alias("entity"), c("DATE").alias("event_date"), c("EVENT").alias("event"),
        c("SEQ").alias("seq"))


@query("""
SELECT r."N_NUMBER" AS entity, e."EVENT_ID" AS event_id,
       CASE WHEN r."N_NUMBER" = e."N_NUMBER" THEN 'mark' ELSE 'serial' END AS matched_by
FROM v_registry r JOIN v_events_ntsb e ON r."N_NUMBER" = e."N_NUMBER"
     OR (r."SERIAL_NUMBER" <> '' AND r."SERIAL_NUMBER" = e."SERIAL_NUMBER")
""", views=("v_registry", "v_events_ntsb"))
def or_key_join(t: Tables):
    return matching.or_key_join(t.v_registry, t.v_events_ntsb).select(
        c("ENTITY").alias("entity"), c("EVENT_ID").alias("event_id"),
        c("MATCHED_BY").alias("matched_by"))


@query(f"""
SELECT r."N_NUMBER" AS entity, {sql_chapter('e."JASC_CODE"')} AS chapter, count(*) AS n
FROM v_registry r JOIN v_reports e ON upper(r."MFR") = upper(e."MFR")
     AND starts_with(upper(r."MODEL"), upper(e."MODEL")) AND r."N_NUMBER" <> e."N_NUMBER"
GROUP BY ALL
""", views=("v_registry", "v_reports"))
def prefix_model_join(t: Tables):
    return matching.prefix_model_counts(
        t.v_registry, t.v_reports, text.chapter_of(c("JASC_CODE"))).select(
        c("ENTITY").alias("entity"), c("LABEL").alias("chapter"), "n")


AD_MATCH = """
    (a."APPLIES_MFR" <> '' AND upper(a."APPLIES_MFR") = upper(r."MFR")
     AND (a."APPLIES_MODEL" = '' OR starts_with(upper(r."MODEL"), upper(a."APPLIES_MODEL"))))
    OR (a."APPLIES_ENG_MFR" <> '' AND upper(a."APPLIES_ENG_MFR") = upper(r."ENG_MFR")
     AND (a."APPLIES_ENG_MODEL" = '' OR starts_with(upper(r."ENG_MODEL"), upper(a."APPLIES_ENG_MODEL"))))
"""


@query(f"""
SELECT r."N_NUMBER" AS entity, a."AD_NUMBER" AS ad_number
FROM v_registry r JOIN v_ads a ON {AD_MATCH}
""", views=("v_registry", "v_ads"))
def ad_applicability_join(t: Tables):
    return matching.ad_applicability_join(t.v_registry, t.v_ads).select(
        c("ENTITY").alias("entity"), c("AD_NUMBER").alias("ad_number"))


@query(f"""
WITH l AS (SELECT DISTINCT list_sort({tokens_sql('"REGISTRANT_NAME"', fixed.NAME_STOPWORDS, 2)}) AS lt
           FROM v_registry),
r AS (SELECT "CASE_ID" AS case_id, {tokens_sql('"RESPONDENT"', fixed.NAME_STOPWORDS, 2)} AS rt
      FROM v_enforcement)
SELECT array_to_string(lt, ' ') AS name, case_id FROM l JOIN r
  ON len(lt) > 0 AND len(list_filter(lt, lambda x: list_contains(rt, x))) >= least(2, len(lt))
""", views=("v_registry", "v_enforcement"))
def token_overlap_join(t: Tables):
    return matching.token_overlap_join(
        t.v_registry, "REGISTRANT_NAME", t.v_enforcement, "RESPONDENT").select(
        c("LEFT_NAME").alias("name"), c("CASE_ID").alias("case_id"))


CONTEXT_SQL = """
  apt AS (SELECT mark, list(DISTINCT upper(a)) AS apts FROM (
      SELECT "N_NUMBER" AS mark, "ORIGIN" AS a FROM v_flights
      UNION ALL SELECT "N_NUMBER", "DEST" FROM v_flights) WHERE a <> '' GROUP BY mark),
  ent AS (SELECT r."N_NUMBER" AS entity, upper(r."MFR") AS emfr, upper(r."MODEL") AS emodel,
                 coalesce(apts, []) AS apts
          FROM v_registry r LEFT JOIN apt ON mark = r."N_NUMBER"),
  ctx AS (SELECT entity, a."ACN" AS acn, a."THEMES" AS themes FROM ent JOIN v_asrs a
     ON (emfr = upper(a."MFR") AND starts_with(emodel, upper(a."MODEL")))
     OR list_contains(apts, upper(a."AIRPORT"))),
  ctx_n AS (SELECT entity, trim(theme) AS theme, count(*) AS n
     FROM (SELECT entity, unnest(string_split(themes, ';')) AS theme FROM ctx)
     WHERE trim(theme) <> '' GROUP BY ALL)
"""


@query(f"""
WITH {CONTEXT_SQL} SELECT * FROM ctx_n
""", views=("v_registry", "v_flights", "v_asrs"))
def context_or_join(t: Tables):
    return matching.context_counts(
        t.v_registry, t.v_flights, t.v_asrs, matching.report_themes()).select(
        c("ENTITY").alias("entity"), c("LABEL").alias("theme"), "n")


@query("""
SELECT f."SEQ" AS seq, f."ORIGIN" AS origin, a."NAME" AS airport_name
FROM v_flights f LEFT JOIN v_airport_risk a ON f."ORIGIN" = a."AIRPORT"
""", views=("v_flights", "v_airport_risk"))
def dimension_lookup(t: Tables):
    return matching.dimension_lookup(
        t.v_flights, "ORIGIN", t.v_airport_risk.select("AIRPORT", "NAME"), "AIRPORT", ["NAME"]).select(
        c("SEQ").alias("seq"), c("ORIGIN").alias("origin"), c("NAME").alias("airport_name"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(p_brand, '') AS brand, coalesce(s_name, '') AS supplier,
       p_partkey IS NULL AS part_unknown, s_suppkey IS NULL AS supplier_unknown
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS pk,
             CASE WHEN l_linenumber = 6 THEN -1 ELSE l_suppkey END AS sk FROM lineitem)
LEFT JOIN part ON pk = p_partkey LEFT JOIN supplier ON sk = s_suppkey
""")
def reference_join(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(c("l_linenumber") == 7, -1).otherwise(c("l_partkey")).alias("pk"),
        F.when(c("l_linenumber") == 6, -1).otherwise(c("l_suppkey")).alias("sk"))
    out = matching.reference_join(rows, {
        "P": (t.part, "pk", "p_partkey", ["p_brand"]),
        "S": (t.supplier, "sk", "s_suppkey", ["s_name"])})
    return out.select("l_orderkey", "l_linenumber", c("P_p_brand").alias("brand"),
                      c("S_s_name").alias("supplier"), c("P_UNKNOWN").alias("part_unknown"),
                      c("S_UNKNOWN").alias("supplier_unknown"))


CANCELLED = {
    "seq": "o_orderkey",
    "N_NUMBER": "'N' || CAST(o_custkey AS STRING)",
    "SERIAL_NUMBER": "CASE WHEN o_orderkey % 3 = 0 THEN ' 0' || CAST(o_custkey AS STRING) || '1' "
                     "ELSE 'X9' END",
    "CANCEL_DATE": "CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) "
                   "ELSE '' END",
}
CANCELLED_EXPRS = [f"{e} AS {n}" for n, e in CANCELLED.items()]


@query(f"""
WITH d AS (SELECT {', '.join(CANCELLED_EXPRS)} FROM orders),
h AS (SELECT "N_NUMBER" AS mark, replace("SERIAL_NUMBER", '-', '') AS serial FROM v_registry)
SELECT seq, d.N_NUMBER AS mark, coalesce(h.serial, '') = '' OR
       regexp_replace(trim(d.SERIAL_NUMBER), '^0+', '') = h.serial AS keep
FROM d LEFT JOIN h ON h.mark = d.N_NUMBER WHERE d.CANCEL_DATE <> ''
""", views=("v_registry",))
def serial_guarded_history(t: Tables):
    rows = t.orders.selectExpr(*CANCELLED_EXPRS)
    return matching.serial_guarded_history(rows, t.v_registry).select(
        "seq", c("N_NUMBER").alias("mark"), c("KEEP").alias("keep"))


@query(f"""
WITH reg AS (SELECT "N_NUMBER" AS mark, "SERIAL_NUMBER" AS serial,
        {header_sql('"MFR"')} || '|' || {header_sql('"MODEL"')} AS mm, {header_sql('"ENG_MODEL"')} AS eng,
        {header_sql('"MODEL"')} AS token FROM v_registry),
toks AS (SELECT DISTINCT token FROM reg WHERE length(token) >= 4),
rep AS (SELECT *, {header_sql('"MFR"')} || '|' || {header_sql('"MODEL"')} AS mm,
        {header_sql('"NARRATIVE"')} AS narr FROM v_reports),
weak AS (SELECT DISTINCT narr FROM (SELECT DISTINCT narr FROM rep), toks WHERE contains(narr, token)),
m AS (SELECT DISTINCT mm FROM reg), me AS (SELECT DISTINCT mm, eng FROM reg)
SELECT "REPORT_ID" AS report_id, coalesce(a.mark, s.mark, '') AS matched,
  CASE WHEN a.mark IS NOT NULL THEN 'EXACT_N_NUMBER' WHEN s.mark IS NOT NULL THEN 'SERIAL_MATCH'
       WHEN me.mm IS NOT NULL THEN 'MAKE_MODEL_ENGINE_MATCH' WHEN m.mm IS NOT NULL THEN 'MODEL_ONLY'
       WHEN weak.narr IS NOT NULL THEN 'WEAK_TEXT_MATCH' ELSE 'NO_MATCH' END AS confidence
FROM rep LEFT JOIN reg a ON regexp_matches("N_NUMBER", '{fixed.MARK_PATTERN}') AND "N_NUMBER" = a.mark
LEFT JOIN reg s ON "SERIAL_NUMBER" <> '' AND "SERIAL_NUMBER" = s.serial
LEFT JOIN m ON rep.mm = m.mm
LEFT JOIN me ON "ENG_MODEL" <> '' AND rep.mm = me.mm AND {header_sql('"ENG_MODEL"')} = me.eng
LEFT JOIN weak ON rep.narr = weak.narr
""", views=("v_registry", "v_reports"))
def match_tiers(t: Tables):
    return matching.match_tiers(
        t.v_reports, t.v_registry, id_col="REPORT_ID", registry_order=["N_NUMBER"]).select(
        c("REPORT_ID").alias("report_id"), c("MATCHED_N_NUMBER").alias("matched"),
        c("CONFIDENCE").alias("confidence"))


@query("""
SELECT "EVENT_ID" AS event_id, coalesce(a."N_NUMBER", s."N_NUMBER", '') AS matched,
  CASE WHEN a."N_NUMBER" IS NOT NULL THEN 'EXACT_N_NUMBER' WHEN s."N_NUMBER" IS NOT NULL
       THEN 'SERIAL_MATCH' ELSE 'MODEL_ONLY' END AS confidence
FROM v_events_ntsb e LEFT JOIN v_registry a ON a."N_NUMBER" = e."N_NUMBER"
LEFT JOIN v_registry s ON s."SERIAL_NUMBER" <> '' AND s."SERIAL_NUMBER" = e."SERIAL_NUMBER"
""", views=("v_registry", "v_events_ntsb"))
def event_match_tiers(t: Tables):
    return matching.event_match_tiers(
        t.v_events_ntsb, t.v_registry, registry_order=["N_NUMBER"]).select(
        c("EVENT_ID").alias("event_id"), c("MATCHED_N_NUMBER").alias("matched"),
        c("CONFIDENCE").alias("confidence"))


@query(f"""
WITH b AS (SELECT regexp_split_to_array(text, '[.\\n]') AS parts FROM benchmark),
s AS (SELECT parts[1] AS mfr, coalesce(parts[2], '') AS model FROM b),
v AS (SELECT {header_sql('mfr')} AS mk, {header_sql('model')} AS md, mfr, model FROM s),
d AS (SELECT doc_id, {header_sql('text')} AS hay FROM documents),
mk AS (SELECT mk, min(mfr) AS mfr FROM v WHERE mk <> '' GROUP BY mk),
md AS (SELECT mk, md, max(model) AS model FROM v WHERE length(md) >= 3 GROUP BY mk, md),
hits AS (SELECT doc_id, mk.mk, mfr, hay FROM d JOIN mk ON contains(hay, mk.mk)),
both_hit AS (SELECT doc_id, hits.mk, mfr, model FROM hits JOIN md ON hits.mk = md.mk AND contains(hay, md.md))
SELECT doc_id, mfr, model, 'TEXT_MATCH' AS confidence FROM both_hit
UNION ALL SELECT doc_id, mfr, '', 'MAKE_TEXT_MATCH' FROM hits
WHERE (doc_id, mk) NOT IN (SELECT (doc_id, mk) FROM both_hit)
""")
def text_vocab_join(t: Tables):
    sentences = F.split("text", "[.\\n]")  # the first sentence of an item and the second, in full
    vocab = t.benchmark.select(sentences[0].alias("MFR"),
                               F.coalesce(F.get(sentences, F.lit(1)), F.lit("")).alias("MODEL"))
    return matching.text_vocab_join(t.documents, vocab, id_col="doc_id", text_col="text").select(
        "doc_id", c("APPLIES_MFR").alias("mfr"), c("APPLIES_MODEL").alias("model"),
        c("APPLICABILITY_CONFIDENCE").alias("confidence"))


@query("""
SELECT "AD_NUMBER" AS ad_number, CASE WHEN "RECURRING" = 'yes' THEN "EFFECTIVE_DATE" ELSE '' END
       AS effective, CASE WHEN "RECURRING" = 'yes' THEN "SUBJECT" ELSE '' END AS subject,
       "APPLIES_MFR" AS mfr,
       'Derived from the wording alone (TEXT_MATCH); look the directive up.' AS notes FROM v_ads
""", views=("v_ads",))
def ads_view(t: Tables):
    a = t.v_ads
    applicability = a.select("AD_NUMBER", "APPLIES_MFR", "APPLIES_MODEL", "APPLIES_ENG_MFR",
                             "APPLIES_ENG_MODEL",
                             F.lit("TEXT_MATCH").alias("APPLICABILITY_CONFIDENCE"))
    directives = a.filter(c("RECURRING") == "yes").select(
        "AD_NUMBER", "EFFECTIVE_DATE", c("SUBJECT").alias("TITLE"))
    return matching.ads_view(applicability, directives).select(
        c("AD_NUMBER").alias("ad_number"), c("EFFECTIVE_DATE").alias("effective"),
        c("SUBJECT").alias("subject"), c("APPLIES_MFR").alias("mfr"), c("NOTES").alias("notes"))


PRIOR_SQL = """
  CASE WHEN CAST(substr(e."DATE", 1, 4) AS INT) < CAST(r."YEAR_MFR" AS INT)
       THEN 'event predates manufacture' END
"""


@query(f"""
SELECT r."N_NUMBER" AS entity, e."EVENT_ID" AS event_id, {PRIOR_SQL} AS reason
FROM v_registry r JOIN v_events_ntsb e ON r."N_NUMBER" = e."N_NUMBER"
     OR (r."SERIAL_NUMBER" <> '' AND r."SERIAL_NUMBER" = e."SERIAL_NUMBER")
""", views=("v_registry", "v_events_ntsb"))
def prior_holder_split(t: Tables):
    return matching.prior_holder_split(t.v_events_ntsb, t.v_registry).select(
        c("ENTITY").alias("entity"), c("EVENT_ID").alias("event_id"), c("REASON").alias("reason"))


@query("""
WITH old AS (SELECT n_name AS k, CAST(n_regionkey AS VARCHAR) AS runs, n_name || '!' AS name FROM nation),
new AS (SELECT 'NATION_' || (c_nationkey + 5) AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(old.k, new.k) AS airport, coalesce(name, '') AS name, coalesce(runs, '') AS runways,
       coalesce(CAST(n AS VARCHAR), '') AS strikes
FROM old FULL JOIN new ON old.k = new.k
""")
def merge_metric_column(t: Tables):
    old = t.nation.select(
        c("n_name").alias("airport"), F.concat("n_name", F.lit("!")).alias("name"),
        c("n_regionkey").cast("string").alias("runways"), F.lit("").alias("strikes"))
    new = t.customer.groupBy(
        F.concat(F.lit("nation_"), (c("c_nationkey") + 5).cast("string")).alias("airport")).agg(
        F.count("*").alias("n"))
    return matching.merge_metric_column(old, new, "airport", "strikes").select(
        "airport", "name", "runways", "strikes")


def _catalog(t: Tables):
    name = lambda k: F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))
    k = c("s_suppkey")
    return t.supplier.select(
        c("s_name").alias("capability_id"), c("s_nationkey").alias("category"),
        F.array(name(k + 1), name(k + 25), F.lit("missing")).alias("fallback_ids"))


@query("""
WITH req AS (SELECT s_nationkey AS cat, min(s_name) AS id FROM supplier GROUP BY 1),
full_req AS (SELECT id, cat, s_suppkey AS k FROM req JOIN supplier ON id = s_name),
dec AS (SELECT id, s_name AS cand, 'declared' AS kind,
               CASE WHEN s_suppkey = k + 1 THEN 0 ELSE 1 END AS pos
        FROM full_req JOIN supplier ON s_suppkey IN (k + 1, k + 25))
SELECT id AS capability_id, cand AS candidate, kind, pos FROM dec
UNION ALL SELECT id, s_name, 'same_category', NULL FROM full_req JOIN supplier ON s_nationkey = cat
WHERE s_name <> id AND (id, s_name) NOT IN (SELECT (id, cand) FROM dec)
""")
def fallback_candidates(t: Tables):
    catalog = _catalog(t)
    requests = catalog.groupBy("category").agg(F.min("capability_id").alias("capability_id"))
    return matching.fallback_candidates(requests, catalog)


@query(f"""
WITH p AS (SELECT *, string_split(p_name, ' ') AS jk,
    (epoch_ms(TIMESTAMP '{ORDERS_AS_OF}') - epoch_ms(TIMESTAMP '2001-08-01')) / 60000 AS age FROM part),
r AS (SELECT p_partkey, list_filter([
   CASE WHEN p_type NOT IN ('ECONOMY', 'global') THEN 'coverage' END,
   CASE WHEN len(list_filter(['red', 'bolt'], lambda x: NOT list_contains(jk, x))) > 0
        THEN 'join keys: ' || array_to_string(list_filter(['red', 'bolt'],
             lambda x: NOT list_contains(jk, x)), ',') END,
   CASE WHEN p_retailprice > 1000 THEN 'cost' END,
   CASE WHEN p_size % 3 = 1 THEN 'auth' END,
   CASE WHEN p_size % 4 <> 0 AND p_size / 50 < 0.5 THEN 'success rate' END,
   CASE WHEN p_size % 5 = 0 OR age > 1000 + p_size * 0 THEN 'receipt age' END,
   CASE WHEN p_brand <> 'Brand#3' THEN 'risk class' END], lambda x: x IS NOT NULL) AS reasons FROM p)
SELECT p_partkey, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS eligible FROM r
""")
def constraint_filter(t: Tables):
    size = c("p_size")
    catalog = t.part.select(
        "p_partkey", F.array("p_type").alias("countries"), F.split("p_name", " ").alias("join_keys"),
        c("p_retailprice").alias("cost"),
        F.when(size % 3 == 0, "none").otherwise("key").alias("auth_type"),
        (size % 3 == 1).alias("auth_paid"),
        F.when(size % 4 != 0, size / 50).alias("success_rate_30d"),
        F.when(size % 5 != 0, F.lit("2001-08-01").cast("timestamp")).alias("verified_at"),
        c("p_brand").alias("risk_class"))
    out = matching.constraint_filter(
        catalog, as_of=ORDERS_AS_OF, country="ECONOMY", join_keys=["red", "bolt"], maximum_cost=1000,
        no_paid_auth=True, minimum_rate=0.5, maximum_age_min=1000, risk_class="Brand#3")
    return out.select("p_partkey", F.array_join("reasons", ";").alias("reasons"), "eligible")


@query("""
WITH chosen AS (SELECT DISTINCT user_id % 45 AS id FROM events),
h AS (SELECT source, arg_max(status, (ts, event_id)) AS status,
  floor(avg(CASE WHEN task_success THEN 1 ELSE 0 END) * 1000 + 0.5) / 1000 AS rate, count(*) AS probes
  FROM v_history WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT id AS capability_id, status, rate AS success_rate_30d, probes AS probes_30d,
       CASE WHEN source IS NULL THEN 'unknown capability' END AS error
FROM chosen LEFT JOIN h ON id = source
""", views=("v_history",))
def compare_sources(t: Tables):
    chosen = t.events.select((c("user_id") % 45).alias("capability_id")).distinct()
    catalog = t.v_history.select(c("source").alias("capability_id")).distinct()
    state = quality.source_state(t.v_history, ORDER, as_of=EVENTS_AS_OF).withColumnRenamed(
        "source", "capability_id")
    return matching.compare_sources(chosen, catalog, state).select(
        "capability_id", "status", "success_rate_30d", "probes_30d", "error")


@query("""
WITH a AS (SELECT source, event_type, 2 * count(*) FILTER (value < 35) >= count(*) AS ok FROM (SELECT user_id % 40 AS source, * FROM events)
           WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
b AS (SELECT source, event_type, 2 * count(*) FILTER (value < 35) >= count(*) AS ok FROM (SELECT user_id % 40 AS source, * FROM events)
      WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT source, event_type, a.ok AS recorded, b.ok AS now FROM a JOIN b USING (source, event_type)
WHERE a.ok <> b.ok
""")
def replay_diff(t: Tables):
    e = t.events.withColumn("source", c("user_id") % 40)
    cut = F.lit("2024-01-16").cast("timestamp")
    outcome = lambda rows: rows.groupBy("source", "event_type").agg(
        (2 * F.count_if(c("value") < 35) >= F.count("*")).alias("ok"))
    ts = c("ts").cast("timestamp")
    return matching.replay_diff(outcome(e.filter(ts < cut)), outcome(e.filter(ts >= cut)),
                                ["source", "event_type"])


@query("""
SELECT c_custkey AS capability_id, CAST(floor(c_acctbal / 100) AS BIGINT) AS score FROM customer
WHERE (c_custkey % 8 = 0 OR floor(c_acctbal / 100) >= 70) AND c_mktsegment <> 'BUILDING'
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
""")
def known_exclusion(t: Tables):
    score = F.floor(c("c_acctbal") / 100)
    cand = t.customer.select(
        c("c_custkey").alias("capability_id"), score.alias("raw"),
        F.when(c("c_custkey") % 8 != 0, score).alias("score"),
        F.when(c("c_mktsegment") == "BUILDING", F.array(F.lit("API_KEY"))).otherwise(
            F.array().cast("array<string>")).alias("requires"),
        F.array(F.lit("TOKEN")).alias("available"))
    known = t.orders.filter((c("o_orderstatus") == "F") & (c("o_orderpriority") == "1-URGENT")).select(
        c("o_custkey").alias("capability_id"))
    return matching.known_exclusion(cand, known).select("capability_id", c("raw").alias("score"))
