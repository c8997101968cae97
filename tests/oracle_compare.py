"""Compare each registered Spark query with its DuckDB SQL twin.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: row counts, column names and an order-insensitive
comparison of the values (floats to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (bool,)):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None):
    from jobtables.plans.catalog import QUERIES
    from jobtables.plans.oracle import ORACLE_SQL
    con = duck(sf_dir)
    results = {}
    for n in names or QUERIES:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[n] = ("SPARK_FAIL", str(e)[:300])
            continue
        t1 = time.time()
        if n not in ORACLE_SQL:
            results[n] = ("NO_ORACLE", f"{len(srows)} rows")
            continue
        try:
            cur = con.execute(ORACLE_SQL[n])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[n] = ("DUCK_FAIL", str(e)[:300])
            continue
        if sorted(scols) != sorted(dcols):
            results[n] = ("COLS", f"spark={scols} duck={dcols}")
            continue
        a, b = canon(scols, srows), canon(dcols, drows)
        if a == b:
            results[n] = ("MATCH", f"{len(a)} rows spark {t1 - t0:.1f}s")
        else:
            sa, sb = set(a), set(b)
            results[n] = ("DIFF", f"spark={len(a)} duck={len(b)} only_spark={list(sa - sb)[:2]} "
                                  f"only_duck={list(sb - sa)[:2]}")
    return results


if __name__ == "__main__":
    from jobtables.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    res = compare(spark, sf, sys.argv[2:] or None)
    for k, (status, msg) in res.items():
        print(f"{status:10s} {k}: {msg}", flush=True)
