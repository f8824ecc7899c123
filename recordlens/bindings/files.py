"""Readers, writers and staged tables, fed with files that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.bindings import Tables, query
from recordlens.bindings.expressions import WS, sql_case
from recordlens.functions import fixed
from recordlens.session import scratch_path
from recordlens.sources import documents, feeds, ingest, registry, store, tables

c = F.col


def _write_csv(df, path: str, encoding: str = "UTF-8") -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"') \
        .option("encoding", encoding).option("emptyValue", "").csv(path)


@query(f"""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, trim(text, {WS}) AS text
FROM conversations
""")
def csv_scan(t: Tables):
    path = scratch_path(t.spark, "csv")
    _write_csv(t.conversations.select("conv_id", c("turn").alias(" turn "),
                                      F.concat(F.lit("  "), "text").alias("text")), path)
    return tables.csv_scan(t.spark, path).select("conv_id", "turn", "text")


@query("""
SELECT 'registry' AS name, count(*) AS rows FROM part UNION ALL SELECT 'flights', count(*) FROM orders
UNION ALL SELECT unnest(['registration_history', 'sdr', 'ntsb', 'ads', 'enforcement', 'asrs', 'airport_risk']), 0
""")
def load_tables(t: Tables):
    base = scratch_path(t.spark, "tables")
    _write_csv(t.v_registry, f"{base}/registry.csv")
    _write_csv(t.v_flights, f"{base}/flights.csv")
    out = None
    for name, df in tables.load_tables(t.spark, base).items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


MASTER = {
    "N-NUMBER": "CAST(p_partkey AS STRING) || '   '",
    "SERIAL NUMBER": "'S' || CAST(p_partkey AS STRING)",
    "MFR MDL CODE": "CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE p_brand END",
    "ENG MFR MDL": "p_type",
    "TYPE REGISTRANT": "CAST(p_size % 10 AS STRING)",
    "NAME": "'Ærø ' || p_name",
    "CERT ISSUE DATE": "CASE WHEN p_size % 2 = 0 THEN '20240102' ELSE '' END",
    "CERTIFICATION": "CAST(p_size % 10 AS STRING) || 'N'",
    "STATUS CODE": "CASE p_size % 4 WHEN 0 THEN 'V ' WHEN 1 THEN 'E' WHEN 2 THEN 'T' ELSE 'Z' END",
    " ": "''",
}
M = {k: v for k, v in MASTER.items()}


@query(f"""
SELECT 'N' || p_partkey AS mark, 'S' || p_partkey AS serial,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'Make ' || p_brand END AS mfr, p_type || ' engine' AS eng_model,
  {sql_case('CAST(p_size % 10 AS VARCHAR)', fixed.REGISTRANT_TYPES, 'CAST(p_size % 10 AS VARCHAR)')} AS rtype,
  'Ærø ' || p_name AS name, CASE WHEN p_size % 2 = 0 THEN '2024-01-02' ELSE '' END AS issued,
  {sql_case('CAST(p_size % 10 AS VARCHAR)', fixed.AIRWORTHINESS_CLASSES, 'CAST(p_size % 10 AS VARCHAR)')} AS class,
  CASE p_size % 4 WHEN 0 THEN 'Valid' WHEN 1 THEN 'Expired' WHEN 2 THEN 'Valid' ELSE 'Z' END AS status FROM part
""")
def registry_bundle_scan(t: Tables):
    base = scratch_path(t.spark, "bundle")
    latin = "ISO-8859-1"
    master = t.part.selectExpr(*[f"{e} AS `{n}`" for n, e in M.items()])
    _write_csv(master, f"{base}/master.TXT", latin)
    _write_csv(t.part.select(c("p_brand").alias("CODE"), F.concat(F.lit("Make "), "p_brand").alias("MFR"),
                             F.lit("X").alias("MODEL")).distinct(), f"{base}/ACFTREF.txt", latin)
    _write_csv(t.part.select(c("p_type").alias("CODE"), F.lit("E").alias("MFR"), F.concat(
        "p_type", F.lit(" engine")).alias("MODEL")).distinct(), f"{base}/Engine.txt", latin)
    bundle = registry.registry_bundle_scan(t.spark, base)
    return registry.registry_current(bundle).select(
        c("N_NUMBER").alias("mark"), c("SERIAL_NUMBER").alias("serial"), c("MFR").alias("mfr"),
        c("ENG_MODEL").alias("eng_model"), c("REGISTRANT_TYPE").alias("rtype"),
        c("REGISTRANT_NAME").alias("name"), c("CERT_ISSUE_DATE").alias("issued"),
        c("AIRWORTHINESS_CLASS").alias("class"), c("STATUS").alias("status"))


@query("""
SELECT event_id, k AS id_text, k AS number FROM (
  SELECT event_id, replace(split_part(props, ': ', 2), '}', '') AS k FROM events)
UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), '' FROM events
""")
def json_candidate_scan(t: Tables):
    body = F.concat(F.lit("{\"cases\": ["), "props", F.lit(", {\"id\": "), "event_id",
                    F.lit(", \"k\": \"\"}, {\"z\": 1}]}"))
    docs = t.events.select("event_id", body.alias("body"))
    return documents.json_candidate_scan(
        docs, "body", {"id_text": ["x.y", "k", "id"], "number": ["k", "a.0.b"]},
        required=("id_text", "number"), keep=("event_id",))


@query("""
SELECT 'E' || event_id AS event_id, strftime(ts, '%Y-%m-%d') AS day, 'N' || user_id AS mark,
       event_type AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://data.ntsb.gov/carol-repgen/api/Aviation/ReportMain/GenerateNewestReport/' || event_id || '/pdf' END AS url
FROM events
""")
def eav_pivot_scan(t: Tables):
    f = lambda name, v: F.struct(F.lit(name).alias("FieldName"), F.array(v).alias("Values"))
    fields = F.array(
        f("NtsbNo", F.concat(F.lit("E"), "event_id")),
        f("EventDate", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        f("N#", F.concat(F.lit(" n-"), "user_id")), f("EventType", c("event_type")),
        f("Other", F.lit("x")),
        f("Mkey", F.when(c("event_id") % 3 == 0, "").otherwise(c("event_id").cast("string"))))
    body = F.to_json(F.struct(F.array(F.struct(fields.alias("Fields"))).alias("Results")))
    rows = documents.eav_pivot_scan(t.events.select(body.alias("body")), "body", "api")
    return rows.select(c("EVENT_ID").alias("event_id"), c("DATE").alias("day"),
                       c("N_NUMBER").alias("mark"), c("EVENT_TYPE").alias("kind"),
                       c("REPORT_URL").alias("url"))


@query("""
SELECT event_id, 0 AS row, CAST(event_id AS VARCHAR) AS id, event_type AS type FROM events
UNION ALL SELECT event_id, 1, 'x', NULL FROM events
""")
def array_table_to_rows(t: Tables):
    body = F.concat(F.lit('[["id", "type"], ["'), "event_id", F.lit('", "'), "event_type",
                    F.lit('"], ["x"]]'))
    rows = documents.array_table_to_rows(t.events.select("event_id", body.alias("body")), "event_id", "body")
    return rows.select("event_id", "row", c("fields")["id"].alias("id"), c("fields")["type"].alias("type"))


@query("""
SELECT event_id, 0 AS pos, replace(split_part(props, ': ', 2), '}', '') AS value FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, 1, '7' FROM events WHERE event_id % 3 = 0
""")
def extract_rows(t: Tables):
    k = F.regexp_extract("props", r"(\d+)", 1)
    body = (F.when(c("event_id") % 3 == 0, F.concat(F.lit('{"a": [{"b": ['), k, F.lit(", 7]}]}")))
            .when(c("event_id") % 3 == 1, F.concat(F.lit('{"a": [{"b": '), k, F.lit("}]}")))
            .otherwise('{"a": [{"b": null}]}'))
    rows = documents.extract_rows(t.events.select("event_id", body.alias("body")), "event_id", "body", "a.0.b")
    return rows.select("event_id", "pos", F.try_variant_get("value", "$", "string").alias("value"))


@query("""
SELECT CAST(source AS VARCHAR) AS capability_id, count(*) AS probes,
       count(*) FILTER (task_success) AS passed, count(schema_hash) AS hashed
FROM v_history WHERE event_id % 25 <> 0 GROUP BY 1
""", views=("v_history",))
def history_scan(t: Tables):
    path = scratch_path(t.spark, "history")
    line = F.to_json(F.struct(
        c("source").cast("string").alias("capability_id"), c("ts").cast("timestamp").alias("ts"),
        c("event_id").cast("string").alias("receipt_id"), "status", "task_success", "latency_ms",
        F.lit(200).alias("http_status"), "schema_hash"))
    lines = F.when(c("event_id") % 25 == 0, F.concat(F.substring(line, 1, 30), F.lit(" broken")))
    t.v_history.select(F.coalesce(lines, line).alias("value")).write.text(path)
    return documents.history_scan(t.spark, path).groupBy("capability_id").agg(
        F.count("*").alias("probes"), F.count_if("task_success").alias("passed"),
        F.count("schema_hash").alias("hashed"))


CONTRACT = ("'{\"capability_id\": \"source.' || (s_suppkey % 60) || '\", \"claim\": \"c\", \"publisher\": "
            "{\"name\": \"p\"}, \"protocol\": \"' || CASE WHEN s_suppkey % 8 = 5 THEN 'ftp' ELSE 'rest' END || "
            "'\", \"category\": \"g\", \"risk_class\": \"read_only\", \"auth\": {\"type\": \"none\"}, \"test_pack\": "
            "{\"id\": \"t\", \"request\": {\"url\": \"u\"}, \"checks\": [{\"type\": \"' || "
            "CASE WHEN s_suppkey % 8 = 6 THEN 'bogus' ELSE 'json' END || '\"}]}}'")


@query("""
WITH f AS (SELECT s_name AS file, 'source.' || (s_suppkey % 60) AS id, s_suppkey AS k,
  CASE WHEN s_suppkey % 8 = 7 THEN 'invalid JSON' WHEN s_suppkey % 8 = 5 THEN 'unknown protocol'
       WHEN s_suppkey % 8 = 6 THEN 'unknown check type' END AS problem FROM supplier),
v AS (SELECT id, min(file) AS first_file FROM f WHERE problem IS NULL GROUP BY id)
SELECT file, CASE WHEN k % 8 <> 7 THEN f.id END AS capability_id,
  coalesce(problem, CASE WHEN file <> first_file THEN 'duplicate capability_id' ELSE '' END) AS problems,
  problem IS NULL AND file = first_file AS in_force FROM f LEFT JOIN v ON f.id = v.id
""")
def contract_catalog(t: Tables):
    body = F.when(c("s_suppkey") % 8 == 7, "{broken").otherwise(F.expr(CONTRACT))
    files = t.supplier.select(c("s_name").alias("file"), body.alias("body"))
    return documents.contract_catalog(files).select(
        "file", "capability_id", F.array_join("problems", ";").alias("problems"), "in_force")


@query("""
SELECT CASE WHEN id % 4 = 3 THEN 'doc' || id ELSE regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2})', 1) END AS ad_number,
       'doc' || id AS document, CASE WHEN id % 2 = 0 THEN '2120-AA1;2120-' || id ELSE '' END AS rin,
       '2024-02-03' AS effective FROM v_ad_text
""", views=("v_ad_text",))
def federal_register_transform(t: Tables):
    txt = F.when(c("id") % 4 != 3, c("text")).otherwise("no number")
    doc = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("doc"), "id").alias("document_number"),
        F.when(c("id") % 4 == 0, txt).otherwise("Rule").alias("title"),
        F.when(c("id") % 4 != 0, txt).alias("abstract"), F.lit("2024-02-03T00:00").alias("effective_on"),
        F.when(c("id") % 2 == 0, F.array(F.lit("2120-AA1"), F.concat(F.lit("2120-"), "id")))
        .alias("regulation_id_numbers"))).alias("results")))
    rows = documents.federal_register_transform(t.v_ad_text.select(doc.alias("body")), "body")
    return rows.select(c("AD_NUMBER").alias("ad_number"), c("FR_DOCUMENT_NUMBER").alias("document"),
                       c("RIN").alias("rin"), c("EFFECTIVE_DATE").alias("effective"))


@query("""
SELECT p_partkey || ',' || q || p_name || ', ' || q || q || 'new' || q || q || q || ',' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS line
FROM part, (SELECT chr(34) AS q)
""")
def csv_sink(t: Tables):
    path = scratch_path(t.spark, "sink")
    rows = t.part.select(c("p_brand"), F.concat("p_name", F.lit(', "new"')).alias("name"), "p_partkey",
                         F.when(c("p_size") % 2 == 0, c("p_brand")).alias("brand"))
    tables.csv_sink(rows, ["p_partkey", "name", "brand"], path)
    return t.spark.read.text(path).filter(c("value") != "p_partkey,name,brand").select(
        c("value").alias("line"))


@query("""
SELECT p_partkey, p_name, 2::BIGINT AS promotions, true AS blocked FROM part
""")
def stage_and_promote(t: Tables):
    """Stages and promotes two tables, then stages one with other columns, which is not promoted."""
    s = store.TableStore(t.spark, scratch_path(t.spark, "store"))
    first = [s.stage("feed", "parts", t.part.select("p_partkey", "p_name")),
             s.stage("feed", "suppliers", t.supplier)]
    s.promote(first)
    changed = [s.stage("feed", "parts", t.part.select("p_partkey", "p_name", "p_brand"))]
    blocked = len(s.schema_changes(changed)) == 1
    promoted = s.promotions().count()
    return s.production("parts").select("p_partkey", "p_name", F.lit(promoted).cast("bigint").alias(
        "promotions"), F.lit(blocked).alias("blocked"))


@query("""
SELECT source, doc_id, sha256(text) AS hash,
       coalesce(lag(text) OVER (PARTITION BY source ORDER BY doc_id) = text, false) AS duplicate FROM documents
""")
def artifact_dedupe(t: Tables):
    files = t.documents.select(c("source").alias("name"), "doc_id", c("text").cast("binary").alias("content"))
    return store.artifact_dedupe(files, ["doc_id"], F.floor(c("doc_id") / 512)).select(
        c("name").alias("source"), "doc_id", c("sha256").alias("hash"), "duplicate")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, 's' || (user_id % 8) AS source_name, event_type AS status, count(*) AS runs
FROM events GROUP BY ALL
""")
def health_log(t: Tables):
    path = scratch_path(t.spark, "health")
    values = {"run_started_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "status": c("event_type"),
              "source_name": F.concat(F.lit("s"), (c("user_id") % 8).cast("string"))}
    for half in (0, 1):  # two appends to the log
        rows = t.events.filter(c("event_id") % 2 == half)
        rows.select(*[values.get(n, F.lit("")).alias(n) for n in feeds.HEALTH]).write.mode(
            "append").parquet(f"{path}/source_health")
    return store.daily_health(store.read_health(t.spark, path))


@query("""
WITH d AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem),
s AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem WHERE year(l_shipdate) <> 1997)
SELECT d.year, CASE WHEN d.year NOT BETWEEN 1996 AND 2001 THEN 'outside'
  WHEN s.year IS NOT NULL AND d.year < 2000 THEN 'keep' ELSE 'fetch' END AS action FROM d LEFT JOIN s USING (year)
""")
def incremental_years(t: Tables):
    years = t.lineitem.select(F.year("l_shipdate").alias("year"))
    return tables.incremental_years(years, years.filter(c("year") != 1997), "1996:current", 2001)


@query("SELECT c_custkey, c_name, c_mktsegment, 'json' AS form FROM customer UNION ALL "
       "SELECT c_custkey, c_name, c_mktsegment, 'csv' FROM customer")
def batch_sink(t: Tables):
    path = scratch_path(t.spark, "batch")
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    tables.batch_sink(rows, path)
    js = t.spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(
        f"{path}/records_json").withColumn("form", F.lit("json"))
    cs = tables.csv_scan(t.spark, f"{path}/records_csv").withColumns({
        "c_custkey": c("c_custkey").cast("bigint"), "form": F.lit("csv")})
    return js.unionByName(cs)


@query("""
WITH r AS (SELECT CAST(2019 + l_linenumber % 4 AS VARCHAR) AS y, l_linenumber % 2 = 0 AS named,
  CAST(l_orderkey AS VARCHAR) AS id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(l_suppkey AS VARCHAR) AS supp,
  l_returnflag AS mfr, l_linestatus AS model FROM lineitem),
h AS (SELECT *, sha256(concat_ws('|', '', day, supp, '', mfr, model, '', '', '', '', model, '', '')) AS d FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY y, named, d) AS turn FROM h)
SELECT y AS year, CASE WHEN named THEN id ELSE y || '-' || d || CASE WHEN turn > 1 THEN '-' || turn ELSE '' END END AS report,
  day, 'N' || supp AS mark, mfr, model, CASE WHEN named THEN '' ELSE model END AS part FROM n
""")
def multi_file_union(t: Tables):
    """Four yearly files of two layouts; of two years the reports have no id of their own."""
    base = scratch_path(t.spark, "years")
    rows = t.lineitem.withColumns({
        "year": 2019 + c("l_linenumber") % 4, "day": c("l_shipdate").cast("date").cast("string")})
    named = rows.select("year", c("l_orderkey").alias("SDR No"), c("day").alias("Difficulty Date"),
                        c("l_suppkey").alias("Registration Number"), c("l_returnflag").alias("ACFT MAKE"),
                        c("l_linestatus").alias("Model"))
    without = rows.select("year", c("day").alias("DATE"), c("l_suppkey").alias("n-number"), c("l_returnflag").alias("MFR"),
                          c("l_linestatus").alias("AIRCRAFT_MODEL"), c("l_linestatus").alias("component name"))
    for year in range(2019, 2023):
        layout = without if year % 2 == 0 else named
        tables.csv_sink(layout.filter(c("year") == year), layout.columns[1:], f"{base}/sdr_{year}.csv")
    found, _, _ = tables.yearly_files(t.spark, ingest.landed_files(t.spark, base), feeds.SDR_HEADERS, feeds.SDR_ESSENTIAL)
    return found.select(c("SOURCE_YEAR").alias("year"), c("REPORT_ID").alias("report"), c("DATE").alias("day"),
                        c("N_NUMBER").alias("mark"), c("MFR").alias("mfr"), c("MODEL").alias("model"),
                        c("PART_NAME").alias("part"))
