"""Views that give the driver tables the columns of the public-record feeds.

Each view is one projection of one or two tables. The expressions are plain SQL that reads the
same in Spark and in the checking engine, so a view is defined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-02"
LINEITEM_AS_OF = "2001-11-05"

_WORD1 = (
    "CASE {k} % 8 WHEN 0 THEN 'small' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' WHEN 3 THEN 'green' "
    "WHEN 4 THEN 'large' WHEN 5 THEN 'shiny' WHEN 6 THEN 'hot' ELSE 'old' END"
)
_WORD2 = (
    "CASE CAST(floor({k} / 8) AS INT) % 8 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' WHEN 2 THEN 'bolt' "
    "WHEN 3 THEN 'gear' WHEN 4 THEN 'nut' WHEN 5 THEN 'pin' WHEN 6 THEN 'cog' ELSE 'cap' END"
)


def _word1(k: str) -> str:
    return _WORD1.format(k=k)


def _word2(k: str) -> str:
    return _WORD2.format(k=k)


# name -> (FROM clause, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_history": ("events", {
        "source": "user_id % 40",
        "ts": "ts",
        "event_id": "event_id",
        "task_success": "event_type <> 'error'",
        "latency_ms": "value",
        "status": "CASE WHEN event_type <> 'error' THEN 'verified' ELSE 'failed_checks' END",
        "schema_hash": "CASE WHEN event_type IN ('click', 'view') THEN event_type END",
        "checks_passed": "CASE WHEN event_type <> 'error' THEN 3 ELSE 1 END",
        "checks_total": "3",
    }),
    "v_registry": ("part", {
        "N_NUMBER": "'N' || CAST(p_partkey AS STRING)",
        "SERIAL_NUMBER": "CASE WHEN p_partkey % 17 = 0 THEN '' "
                         "ELSE CAST(p_partkey AS STRING) || '-1' END",
        "MFR": "p_brand",
        "MODEL": "p_name",
        "ENG_MFR": "p_type",
        "ENG_MODEL": "CAST(p_size AS STRING)",
        "YEAR_MFR": "CAST(1990 + p_partkey % 14 AS STRING)",
        "REGISTRANT_TYPE": "CAST(p_partkey % 9 AS STRING)",
        "REGISTRANT_NAME": "p_name || CASE WHEN p_size % 5 = 0 THEN ' Trust' ELSE ' LLC' END",
        "CITY": "'City ' || CAST(p_size AS STRING)",
        "STATE": "'ST'",
        "STATUS": "CASE WHEN p_size % 7 = 0 THEN 'Expired' ELSE 'Valid' END",
        "MODE_S_HEX": "CASE WHEN p_partkey % 11 = 0 THEN '' "
                      "ELSE 'A' || CAST(p_partkey AS STRING) END",
        "EXPIRATION_DATE": "CASE WHEN p_partkey % 13 = 0 THEN '2000-01-01' ELSE '2005-01-01' END",
    }),
    "v_owner_history": ("orders", {
        "N_NUMBER": "'N' || CAST(o_custkey AS STRING)",
        "DATE": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
        "EVENT": "CASE o_orderstatus WHEN 'O' THEN 'Ownership change' "
                 "WHEN 'P' THEN 'Registration change' ELSE 'Registration cancelled' END",
        "DETAILS": "o_orderpriority",
        "SEQ": "o_orderkey",
    }),
    "v_flights": ("orders", {
        "N_NUMBER": "'N' || CAST(o_custkey AS STRING)",
        "DATE": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
        "ORIGIN": "CAST(o_orderkey % 7 AS STRING)",
        "DEST": "CAST((o_orderkey + o_custkey) % 7 AS STRING)",
        "DURATION_MIN": "CAST(CAST(floor(o_totalprice / 2000) AS INT) AS STRING)",
        "SEQ": "o_orderkey",
    }),
    "v_reports": ("lineitem JOIN part ON l_partkey = p_partkey", {
        "REPORT_ID": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
        "DATE": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
        "N_NUMBER": "'N' || CAST(l_orderkey AS STRING)",
        "SERIAL_NUMBER": "CASE WHEN l_linenumber = 2 THEN CAST(l_partkey AS STRING) || '-1' ELSE '' END",
        "MFR": "CASE WHEN l_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE p_brand END",
        "MODEL": "CASE WHEN l_suppkey % 5 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END",
        "ENG_MODEL": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(p_size AS STRING) ELSE '' END",
        "JASC_CODE": "lpad(CAST(p_size AS STRING), 2, '0') || '10'",
        "PART_NAME": "split_part(p_name, ' ', 2)",
        "NARRATIVE": "CASE WHEN l_linenumber % 3 = 0 THEN 'found ' || p_name || ' worn' "
                     "ELSE 'no detail' END",
    }),
    "v_events_ntsb": ("lineitem JOIN part ON l_partkey = p_partkey", {
        "EVENT_ID": "CAST(l_orderkey AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || "
                    "CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING)",
        "DATE": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
        "N_NUMBER": "'N' || CAST(l_orderkey AS STRING)",
        "SERIAL_NUMBER": "CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
        "MFR": "p_brand",
        "MODEL": "split_part(p_name, ' ', 1)",
        "CITY": "'C' || CAST(l_suppkey AS STRING)",
        "STATE": "'ST'",
        "HIGHEST_INJURY": "CASE l_linenumber WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' "
                          "WHEN 3 THEN 'minor' WHEN 4 THEN '' ELSE 'None' END",
        "DAMAGE": "CASE l_returnflag WHEN 'A' THEN 'Destroyed' WHEN 'N' THEN 'minor' ELSE '' END",
        "STATUS": "CASE l_linestatus WHEN 'F' THEN 'Completed' ELSE 'closed' END",
        "PROBABLE_CAUSE": "CASE p_size % 6 WHEN 0 THEN 'loss of control during landing' "
                          "WHEN 1 THEN 'fuel exhaustion' WHEN 2 THEN 'engine failure in icing' "
                          "WHEN 3 THEN 'Stall after gear collapse' ELSE 'unknown' END",
        "EVENT_TYPE": "CASE WHEN l_suppkey % 2 = 0 THEN 'Accident' ELSE 'Incident' END",
        "HAS_SAFETY_REC": "CASE WHEN l_suppkey % 9 = 0 THEN 'Yes' ELSE 'No' END",
        "REPORT_TYPE": "CASE WHEN l_suppkey % 4 = 0 THEN 'Final' ELSE 'Preliminary' END",
        "INJURY_ONBOARD": "CAST(l_linenumber AS STRING)",
        "INJURY_ONGROUND": "'0'",
        "REPORT_URL": "''",
    }),
    "v_ads": ("supplier", {
        "AD_NUMBER": "'AD-' || CAST(s_suppkey AS STRING)",
        "EFFECTIVE_DATE": "CAST(CAST(1994 + s_suppkey % 8 AS STRING) || '-06-15' AS STRING)",
        "SUBJECT": "s_name",
        "APPLIES_MFR": "CASE WHEN s_suppkey % 5 = 4 THEN '' "
                       "ELSE 'brand#' || CAST(s_suppkey % 25 + 1 AS STRING) END",
        "APPLIES_MODEL": f"CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE {_word1('s_suppkey')} END",
        "APPLIES_ENG_MFR": "CASE WHEN s_suppkey % 5 = 4 THEN 'ECONOMY' ELSE '' END",
        "APPLIES_ENG_MODEL": "CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '' END",
        "RECURRING": "CASE WHEN s_suppkey % 3 = 1 THEN 'yes' ELSE 'no' END",
        "COST_BAND": "CASE s_suppkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' "
                     "WHEN 2 THEN '' ELSE 'low' END",
        "NOTES": "''",
    }),
    "v_enforcement": ("supplier", {
        "CASE_ID": "'C' || CAST(s_suppkey AS STRING)",
        "DATE_CLOSED": "CAST(1993 + s_suppkey % 9 AS STRING) || '-03-01'",
        "RESPONDENT": f"{_word1('s_suppkey')} || ' ' || {_word2('s_suppkey')} || ' Inc'",
        "RESPONDENT_TYPE": "'operator'",
        "ACTION": "CASE s_suppkey % 4 WHEN 0 THEN 'revocation' WHEN 1 THEN 'Suspension' "
                  "WHEN 2 THEN 'civil_penalty' ELSE 'warning' END",
        "AMOUNT": "CASE WHEN s_suppkey % 4 = 2 THEN '$500' ELSE '' END",
        "SUMMARY": "s_name",
    }),
    "v_asrs": ("events", {
        "ACN": "CAST(event_id AS STRING)",
        "DATE": "CAST(CAST(ts AS DATE) AS STRING)",
        "MFR": "'BRAND#' || CAST(user_id % 25 + 1 AS STRING)",
        "MODEL": _word1("event_id"),
        "AIRPORT": "CAST(event_id % 400 AS STRING)",
        "THEMES": "event_type || '; k' || CAST(event_id % 9 AS STRING) || ';'",
        "SYNOPSIS": "props",
    }),
    "v_airport_risk": ("nation", {
        "AIRPORT": "CAST(n_nationkey AS STRING)",
        "NAME": "n_name",
        "RUNWAY_INCURSIONS_5YR": "CAST((n_nationkey * 3) % 17 AS STRING)",
        "WILDLIFE_STRIKES_5YR": "CAST((n_nationkey * 37) % 90 AS STRING)",
        "COASTAL": "CASE WHEN n_regionkey = 1 THEN 'yes' ELSE 'no' END",
        "NOTES": "CASE WHEN n_nationkey % 3 = 1 THEN 'Coastal base' ELSE 'inland' END",
    }),
    "v_ad_text": ("orders", {
        "id": "o_orderkey",
        "text": "'AD ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' applies to ' || o_orderpriority",
    }),
    "v_files": ("events", {
        "sessionId": "'s' || CAST(user_id % 4 AS STRING)",
        "timestamp": "ts",
        "event_id": "event_id",
        "eventType": "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' "
                     "ELSE 'change' END",
        "filePath": "'d' || CAST(user_id % 10 AS STRING) || '/s' || CAST(user_id % 3 AS STRING) || "
                    "'/f' || CAST(user_id AS STRING) || '.js'",
        "branchPath": "'d' || CAST(user_id % 10 AS STRING) || '/s' || CAST(user_id % 3 AS STRING)",
        "lines": "CAST(floor(value * 10) AS INT)",
        "imports": "CAST(floor(CAST(replace(split_part(props, ': ', 2), '}', '') AS INT) / 4) AS INT)",
        "exports": "CAST(floor(CAST(replace(split_part(props, ': ', 2), '}', '') AS INT) / 8) AS INT)",
    }),
    "v_carriers": ("customer", {
        "dot_number": "CAST(c_custkey AS STRING)",
        "legal_name": "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END",
        "status_code": "CASE WHEN c_custkey % 10 = 3 THEN 'I' ELSE 'A' END",
        "power_units": "CASE WHEN c_custkey % 12 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END",
        "total_drivers": "CAST(c_custkey % 30 AS STRING)",
        "add_date": "CASE WHEN c_custkey % 6 = 0 THEN '20010501' WHEN c_custkey % 6 = 1 THEN "
                    "'20001101' WHEN c_custkey % 6 = 2 THEN 'n/a' ELSE '19900101' END",
    }),
    "v_crashes": ("orders", {
        "dot_number": "CAST(o_custkey AS STRING)",
        "crash_id": "CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)",
        "report_date": "replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')",
        "fatalities": "CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '' END",
        "injuries": "CAST(o_orderkey % 4 AS STRING)",
        "tow_away": "CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'not' END",
    }),
    "v_inspections": ("lineitem", {
        "dot_number": "CAST(l_suppkey AS STRING)",
        "inspection_id": "CAST(l_orderkey AS STRING)",
        "insp_date": "replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', '')",
        "viol_total": "CAST(l_linenumber % 3 AS STRING)",
        "oos_total": "CAST(l_linenumber % 2 AS STRING)",
        "vehicle_oos_total": "CASE WHEN l_returnflag = 'A' THEN '2' ELSE '0' END",
        "driver_oos_total": "CASE WHEN l_linenumber = 7 THEN '1' ELSE '' END",
        "hazmat_oos_total": "'0'",
    }),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table as it is stored."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    tables = source.split(" JOIN ")
    df = load(spark, sf_dir, tables[0])
    if len(tables) == 2:
        right, on = tables[1].split(" ON ")
        left_key, right_key = on.split(" = ")
        other = load(spark, sf_dir, right)
        df = df.join(other, df[left_key] == other[right_key])
    return df.selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])


def view_sql(*names: str) -> str:
    """WITH clause that defines the views for the checking engine."""
    ctes = []
    for name in names:
        source, columns = VIEWS[name]
        cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
        ctes.append(f"{name} AS (SELECT {cols} FROM {source})")
    return "WITH " + ", ".join(ctes)
