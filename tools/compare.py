"""Run queries in Spark and their oracle SQL in DuckDB, compare rows order-insensitively.

usage: python tools/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, f"{round(v, 6):.6f}")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (1, f"{float(v):.6f}")
    if isinstance(v, (dt.datetime, dt.date)):
        return (1, v.isoformat())
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (1, repr([_norm(x) for x in v]))
    return (1, str(v))


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "boolean": "BOOLEAN",
}


def type_diff(sdf, rel):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)}


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, key, fn, sql, sf_dir, show=3):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    res = {"key": key, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(dcols, drows)
    if ac != bc:
        res["status"] = f"COLUMNS spark={ac} oracle={bc}"
        return res
    td = type_diff(sdf, rel)
    if a == b and td:
        res["status"] = f"TYPES {td}"
    elif a == b:
        res["status"] = "ok"
    else:
        sa, sb = set(a), set(b)
        res["status"] = "MISMATCH"
        res["only_spark"] = [dict(zip(ac, r)) for r in sorted(sa - sb)[:show]]
        res["only_oracle"] = [dict(zip(bc, r)) for r in sorted(sb - sa)[:show]]
    return res


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from hotspot.plans import all_queries, all_sql
    from hotspot.session import get_session

    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    q, s = all_queries(), all_sql()
    keys = args or list(q)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, q[k], s.get(k), sf_dir)
        except Exception as e:  # report and continue
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys)} keys, {bad} not ok")


if __name__ == "__main__":
    main()
