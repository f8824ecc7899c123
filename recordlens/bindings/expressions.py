"""Column expressions (identifiers, codes, dates, text, paths, labels) on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.functions import dates, fixed, numbers, shape, text
from recordlens.operators import aggregates
from recordlens.plans import activity, modules, quality
from recordlens.sources import documents, feeds, registry, tables
from recordlens.views import EVENTS_AS_OF, ORDERS_AS_OF

c = F.col
WS = "E' \\t\\r\\n\\f\\x0b' || chr(160)"


def sql_case(subject: str, table: dict, default: str) -> str:
    """CASE over a fixed code table, for the checking SQL."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {subject} {whens} ELSE {default} END"


def sql_rules(subject: str, rules: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{lab}'" for p, lab in rules)
    return f"CASE {whens} ELSE {default} END"


def sql_chapter(code: str) -> str:
    p = f"substr({code}, 1, 2)"
    return sql_case(p, fixed.CHAPTERS, f"'JASC ' || {p}")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("""
SELECT c_custkey, CASE WHEN m <> '' AND NOT starts_with(m, 'N') THEN 'N' || m ELSE m END AS mark
FROM (SELECT c_custkey, regexp_replace(upper(c_name || ' - ' || c_mktsegment), '[\\s-]', '', 'g') AS m
      FROM customer)
""")
def normalize_id(t: Tables):
    raw = F.concat_ws(" - ", "c_name", "c_mktsegment")
    return t.customer.select("c_custkey", text.normalize_mark(raw).alias("mark"))


MARKS = ("CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS STRING) "
         "WHEN 1 THEN 'n-' || CAST(p_partkey AS STRING) || upper(substr(p_name, 1, 1)) "
         "WHEN 2 THEN CAST(p_partkey AS STRING) || upper(substr(p_name, 2, 2)) "
         "ELSE '0' || CAST(p_partkey AS STRING) END")


@query(f"""
SELECT p_partkey, raw, regexp_matches(CASE WHEN starts_with(m, 'N') THEN m ELSE 'N' || m END,
       '{fixed.MARK_PATTERN}') AS valid
FROM (SELECT p_partkey, raw, regexp_replace(upper(raw), '[\\s-]', '', 'g') AS m
      FROM (SELECT p_partkey, {MARKS} AS raw FROM part))
""")
def validate_id(t: Tables):
    return t.part.selectExpr("p_partkey", f"{MARKS} AS raw").withColumn(
        "valid", text.is_valid_mark(c("raw")))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(upper(' ' || p_name || ' / ' || p_brand || '#'),
       '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS header FROM part
""")
def normalize_header(t: Tables):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("#"))
    return t.part.select("p_partkey", text.normalize_header(raw).alias("header"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS "REPORT_ID", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "DATE",
       o_orderstatus AS "MFR", o_orderpriority AS "MODEL", '' AS "NARRATIVE" FROM orders
""")
def reconcile_columns(t: Tables):
    raw = t.orders.select(
        c("o_orderkey").cast("string").alias("Control Number"),
        c("o_orderdate").cast("date").cast("string").alias("difficulty-date"),
        c("o_orderstatus").alias("Aircraft Make"), c("o_orderpriority").alias("ACFT_MODEL"))
    out, _ = tables.reconcile_columns(raw, feeds.SDR_HEADERS, feeds.SDR_ESSENTIAL)
    return out.select("REPORT_ID", "DATE", "MFR", "MODEL", "NARRATIVE")


@query(f"""
SELECT l_returnflag, l_linenumber,
       {sql_case('l_returnflag', fixed.STATUS_CODES, 'l_returnflag')} AS status,
       {sql_case('CAST(l_linenumber AS VARCHAR)', fixed.REGISTRANT_TYPES,
                 'CAST(l_linenumber AS VARCHAR)')} AS registrant,
       {sql_case('substr(CAST(l_linenumber AS VARCHAR), 1, 1)', fixed.AIRWORTHINESS_CLASSES,
                 "substr(CAST(l_linenumber AS VARCHAR), 1, 1)")} AS class,
       count(*) AS n
FROM lineitem GROUP BY ALL
""")
def decode_codes(t: Tables):
    ln = c("l_linenumber").cast("string")
    return t.lineitem.select(
        "l_returnflag", "l_linenumber", registry.decode_status(c("l_returnflag")).alias("status"),
        registry.decode_registrant(ln).alias("registrant"),
        registry.decode_class(F.concat(ln, F.lit("N"))).alias("class"),
    ).groupBy("l_returnflag", "l_linenumber", "status", "registrant", "class").agg(
        F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN regexp_matches(d, '^\\d{8}$')
       THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) ELSE '' END AS iso
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a'
      ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
""")
def parse_compact_date(t: Tables):
    raw = F.when(c("o_orderkey") % 10 == 0, "n/a").otherwise(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyyMMdd")))
    return t.orders.select("o_orderkey", dates.compact_to_iso(raw).alias("iso"))


@query("""
SELECT c_custkey, regexp_replace(regexp_replace(upper(' ' || substr(c_name, 10) || '-a'),
       '[\\s-]', '', 'g'), '^0+', '') AS serial FROM customer
""")
def normalize_serial(t: Tables):
    raw = F.concat(F.lit(" "), F.substring("c_name", 10, 100), F.lit("-a"))
    return t.customer.select("c_custkey", text.normalize_serial(raw).alias("serial"))


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE
       date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') END AS age FROM orders
""")
def age_days(t: Tables):
    raw = F.when(c("o_orderkey") % 9 == 0, "unknown").otherwise(
        c("o_orderdate").cast("date").cast("string"))
    return t.orders.select("o_orderkey", dates.text_age_days(raw, ORDERS_AS_OF).alias("age"))


@query(f"""
SELECT o_orderkey,
       CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') / 30.44
            * 10000 + 0.5) AS BIGINT) AS months_x10000 FROM orders
""")
def months_since(t: Tables):
    months = dates.months_since(c("o_orderdate").cast("date"), ORDERS_AS_OF)
    return t.orders.select("o_orderkey", numbers.half_up(months * 10000).alias("months_x10000"))


@query(f"""
SELECT o_orderstatus, CAST(DATE '{ORDERS_AS_OF}' - INTERVAL 24 MONTH AS DATE)::VARCHAR AS cutoff,
       count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_date
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{ORDERS_AS_OF}' - INTERVAL 24 MONTH GROUP BY ALL
""")
def rolling_cutoff(t: Tables):
    cut = dates.rolling_cutoff(ORDERS_AS_OF, 24)
    d = c("o_orderdate").cast("date")
    return t.orders.filter(d >= cut).groupBy(
        "o_orderstatus", cut.cast("string").alias("cutoff")).agg(
        F.count("*").alias("n"), F.min(d).cast("string").alias("first_date"))


@query("""
SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_no,
       CAST(0 AS BIGINT) AS name_no,
       CAST(-p_size AS BIGINT) AS signed_no FROM part
""")
def parse_int_prefix(t: Tables):
    return t.part.select(
        "p_partkey",
        numbers.int_or_zero(F.concat(F.substring("p_brand", 7, 10), F.lit(" units"))).alias("brand_no"),
        numbers.int_or_zero(c("p_name")).alias("name_no"),
        numbers.int_or_zero(F.concat(F.lit(" -"), "p_size", F.lit(".5"))).alias("signed_no"))


@query(f"""
SELECT doc_id, {sql_rules('text', fixed.CATEGORY_RULES,
       "CASE WHEN source = 'src1' THEN 'certificate' ELSE 'other' END")} AS category FROM documents
""")
def categorize_text(t: Tables):
    action = F.when(c("source") == "src1", "Suspension").otherwise("warning")
    return t.documents.select("doc_id", text.categorize(c("text"), action).alias("category"))


FLAGS = ("CASE o_orderkey % 8 WHEN 0 THEN 'Y' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN 'None' "
         "WHEN 4 THEN '' WHEN 5 THEN 'No Damage' WHEN 6 THEN '1' ELSE o_orderstatus END")


@query(f"""
SELECT o_orderkey, regexp_matches(trim(f), '(?i)^(y|yes|true|1)$') AS truthy,
       trim(f) <> '' AND NOT regexp_matches(lower(trim(f)), '^(n|no|none|no damage|0)$') AS damaging
FROM (SELECT o_orderkey, {FLAGS} AS f FROM orders)
""")
def truthy_flags(t: Tables):
    return t.orders.selectExpr("o_orderkey", f"{FLAGS} AS f").select(
        "o_orderkey", text.is_true(c("f")).alias("truthy"), text.is_damaging(c("f")).alias("damaging"))


@query(f"""
SELECT conv_id, turn, array_to_string(list_filter(list_transform(
         string_split_regex(text, '[;,/|]+'), lambda x: trim(x, {WS})),
         lambda x: x <> ''), ';') AS themes FROM conversations
""")
def split_themes(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", F.array_join(text.split_themes(c("text")), ";").alias("themes"))


NAME = "p_name || ' ' || p_brand || ' ' || p_name || ' Aviation, Inc.'"
WORDS = f"string_split_regex(regexp_replace(upper({NAME}), '[^A-Z0-9 ]', ' ', 'g'), '\\s+')"


@query(f"""
SELECT p_partkey,
  array_to_string(list_filter({WORDS}, lambda x: length(x) > 1 AND NOT list_contains(
    {sql_list(fixed.NAME_STOPWORDS)}, x)), ' ') AS name_words,
  array_to_string(list_sort(list_distinct(list_filter({WORDS}, lambda x: length(x) >= 3 AND NOT
    list_contains({sql_list(fixed.MAKE_STOPWORDS)}, x)))), ' ') AS make_words,
  len(list_filter(string_split_regex(lower({NAME}), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS task_words
FROM part
""")
def name_tokens(t: Tables):
    df = t.part.selectExpr("p_partkey", f"{NAME} AS name")
    return df.select(
        "p_partkey", F.array_join(text.name_tokens(c("name")), " ").alias("name_words"),
        F.array_join(F.array_sort(text.make_tokens(c("name"))), " ").alias("make_words"),
        F.size(text.task_tokens(c("name"))).alias("task_words"))


@query(f"""
SELECT p_partkey, {sql_chapter("lpad(CAST(p_size AS VARCHAR), 2, '0') || '10'")} AS chapter FROM part
""")
def chapter_of(t: Tables):
    code = F.concat(F.lpad(c("p_size").cast("string"), 2, "0"), F.lit("10"))
    return t.part.select("p_partkey", text.chapter_of(code).alias("chapter"))


LABEL_UNION = " UNION ALL ".join(
    f"SELECT entity, '{lab}' AS label, count(*) AS n FROM texts WHERE regexp_matches(body, '{p}') "
    "GROUP BY entity" for p, lab in fixed.CAUSE_THEMES)


@query(f"""
WITH texts AS (SELECT source AS entity, text AS body FROM documents
               UNION ALL SELECT MFR, PROBABLE_CAUSE FROM v_events_ntsb)
{LABEL_UNION}
""", views=("v_events_ntsb",))
def multi_label_regex(t: Tables):
    texts = t.documents.select(c("source").alias("entity"), c("text").alias("body")).unionByName(
        t.v_events_ntsb.select(c("MFR").alias("entity"), c("PROBABLE_CAUSE").alias("body")))
    long = texts.select("entity", F.explode(
        text.all_labels(c("body"), fixed.CAUSE_THEMES)).alias("label"))
    return long.groupBy("entity", "label").agg(F.count("*").alias("n"))


@query("""
SELECT id, regexp_extract(text, '\\b(\\d{2,4}-\\d{2}-\\d{2})\\b', 1) AS ad_number FROM v_ad_text
""", views=("v_ad_text",))
def extract_first_match(t: Tables):
    return t.v_ad_text.select("id", text.ad_number(c("text")).alias("ad_number"))


@query("""
WITH raw AS (
  SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
         regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) AS scheme,
         regexp_extract(url, '^([^?#]*)', 1) AS page,
         regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS hrefs FROM pages),
long AS (SELECT page_id, origin, scheme, page, unnest(hrefs) AS h,
                generate_subscripts(hrefs, 1) - 1 AS pos FROM raw)
SELECT page_id, pos, CASE
  WHEN regexp_matches(trim(h), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(h)
  WHEN starts_with(trim(h), '//') THEN scheme || trim(h)
  WHEN starts_with(trim(h), '/') THEN origin || trim(h)
  WHEN starts_with(trim(h), '?') THEN page || trim(h)
  WHEN page = origin THEN origin || '/' || trim(h)
  ELSE regexp_replace(page, '[^/]*$', '') || trim(h) END AS link FROM long
""")
def extract_links(t: Tables):
    return documents.extract_links(t.pages, "page_id", "url", "html")


@query("""
SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) AS chars,
  len(regexp_extract_all(text, '(?m)^import\\s')) + len(regexp_extract_all(text, 'require\\(')) AS imports,
  len(regexp_extract_all(text, '(?m)^export\\s')) + len(regexp_extract_all(text, 'module\\.exports')) AS exports
FROM documents
""")
def file_metrics(t: Tables):
    return activity.file_metrics(t.documents, "text").select(
        "doc_id", "lines", "chars", "imports", "exports")


BAND_SQL = " ".join(f"WHEN s <= {m} THEN '{lab}'" for m, lab in fixed.SCORE_BANDS)


@query(f"""
SELECT c_custkey, CASE {BAND_SQL} END AS band,
       CASE WHEN v <= 20 THEN 'low' WHEN v <= 60 THEN 'moderate' ELSE 'high' END AS level
FROM (SELECT c_custkey, c_acctbal / 80 AS v, greatest(0, least(100, c_acctbal / 80)) AS s FROM customer)
""")
def band_lookup(t: Tables):
    v = c("c_acctbal") / 80
    return t.customer.select("c_custkey", text.band(v).alias("band"),
                             text.priority_level(v).alias("level"))


@query("""
SELECT "EVENT_ID" AS event_id, 'injuries: ' || "INJURY_ONBOARD" || ' onboard' AS summary, count(*) AS n
FROM v_events_ntsb GROUP BY ALL
""", views=("v_events_ntsb",))
def finding_text(t: Tables):
    return t.v_events_ntsb.select(
        c("EVENT_ID").alias("event_id"),
        modules.injury_summary(c("INJURY_ONBOARD"), c("INJURY_ONGROUND")).alias("summary"),
    ).groupBy("event_id", "summary").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, 'sha256:' || sha256('{"k":"number"}') AS schema_hash FROM events
""")
def schema_hash(t: Tables):
    return t.events.select("event_id", shape.schema_hash(c("props")).alias("schema_hash"))


@query("""
SELECT event_id, 'sha256:' || sha256('{"event_id":"' || event_id || '","event_type":"' || event_type ||
       '","user_id":"' || user_id || '"}') AS hash,
       event_id % 7 <> 0 AS intact FROM events
""")
def evidence_hash(t: Tables):
    stored = t.events.withColumn("hash", shape.evidence_hash("event_id", "event_type", "user_id"))
    seen = stored.withColumn("event_type", F.when(c("event_id") % 7 == 0, "altered").otherwise(
        c("event_type")))
    return seen.select("event_id", "hash", (shape.evidence_hash(
        "event_id", "event_type", "user_id") == c("hash")).alias("intact"))


@query("""
SELECT source, floor((0.6 * sum(checks_passed) / sum(checks_total)
       + 0.4 * floor(avg(CASE WHEN task_success THEN 1 ELSE 0 END) * 1000 + 0.5) / 1000) * 1000 + 0.5) / 1000
       AS confidence FROM v_history GROUP BY source
""", views=("v_history",))
def confidence_formula(t: Tables):
    g = t.v_history.groupBy("source").agg(
        F.sum("checks_passed").alias("p"), F.sum("checks_total").alias("n"),
        F.avg(c("task_success").cast("int")).alias("r"))
    return g.select("source", quality.confidence(
        c("p"), c("n"), numbers.half_up_to(c("r"), 3)).alias("confidence"))


@query("""
SELECT p, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir,
       array_to_string(string_split(p, '/')[-2:], '/') AS short,
       len(string_split(p, '/')) AS segments, count(*) AS n
FROM (SELECT filePath AS p FROM v_files UNION ALL SELECT url FROM pages) GROUP BY ALL
""", views=("v_files",))
def path_parts(t: Tables):
    p = t.v_files.select(c("filePath").alias("p")).unionByName(t.pages.select(c("url").alias("p")))
    return p.groupBy("p").agg(F.count("*").alias("n")).select(
        "p", text.dirname(c("p")).alias("dir"), text.last_two_segments(c("p")).alias("short"),
        text.segment_count(c("p")).alias("segments"), "n")


@query("""
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago'
       WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS label
FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 60000000) AS BIGINT)
      AS m FROM events)
""")
def relative_age_label(t: Tables):
    secs = (F.unix_micros(F.lit(EVENTS_AS_OF).cast("timestamp"))
            - F.unix_micros(c("ts").cast("timestamp"))) / 1_000_000
    return t.events.select("event_id", text.age_label(secs).alias("label"))


NOW = "2024-01-30 12:00:00"
_AGE = f"epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)"


@query(f"""
SELECT 'last15' AS filter, count(*) AS n, min(event_id) AS first_id FROM v_files WHERE {_AGE} < 900000000
UNION ALL SELECT 'last30', count(*), min(event_id) FROM v_files WHERE {_AGE} < 1800000000
UNION ALL SELECT 'last60', count(*), min(event_id) FROM v_files WHERE {_AGE} < 3600000000
UNION ALL SELECT 'unhealthy', count(*), min(event_id) FROM v_files
  WHERE lines > 300 OR imports > 15 OR exports > 10
UNION ALL SELECT 'newOnly', count(*), min(event_id) FROM v_files WHERE eventType = 'add'
""", views=("v_files",))
def recency_filters(t: Tables):
    events = activity.file_badges(t.v_files)
    out = None
    for name in activity.FILTERS:
        part = activity.recency_filter(events, name, as_of=NOW).agg(
            F.lit(name).alias("filter"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
SELECT doc_id, sha256(substr(text, 1, {fixed.SAMPLE_CHARS})) AS sample_hash,
       length(text) > {fixed.SAMPLE_CHARS} AS truncated FROM documents
""")
def sample_body(t: Tables):
    sample = F.substring("text", 1, fixed.SAMPLE_CHARS)
    return t.documents.select("doc_id", F.sha2(sample, 256).alias("sample_hash"),
                              (F.length("text") > fixed.SAMPLE_CHARS).alias("truncated"))


@query("""
WITH s AS (SELECT sessionId, count(*) FILTER (eventType = 'add') AS created,
    count(*) FILTER (eventType = 'change') AS modified, count(*) FILTER (eventType = 'unlink') AS deleted
  FROM v_files GROUP BY 1),
b AS (SELECT sessionId, branchPath, count(*) AS n, min((timestamp, event_id)) AS f
      FROM v_files GROUP BY 1, 2),
h AS (SELECT sessionId, branchPath FROM b QUALIFY row_number() OVER
      (PARTITION BY sessionId ORDER BY n DESC, f) = 1)
SELECT sessionId, created || ' files created, ' || modified || ' modified, ' || deleted || ' removed'
       AS headline, 'Most active area: ' || branchPath AS area FROM s JOIN h USING (sessionId)
""", views=("v_files",))
def event_counts_text(t: Tables):
    stats = aggregates.session_stats(t.v_files, order=["timestamp", "event_id"])
    return activity.headline(stats).select("sessionId", "headline", "area")
