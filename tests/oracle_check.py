"""Runs registered queries next to their checking SQL and compares names, counts and values.

Usage: python tests/oracle_check.py [scale] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9)) if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """(ok, rows, message)"""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, len(got), "rows only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = normal(df.columns, got), normal(names, want)
    if a == b:
        return True, len(got), ""
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, len(got), f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"


def main() -> int:
    import __spark_entry__ as entry
    from recordlens.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            ok, n, msg = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as e:
            ok, n, msg = False, -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={n:<8d} {time.time() - t0:6.2f}s {msg}",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
