"""Run queries next to their DuckDB oracle: python tests/oracle_check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def make_spark(extra: dict | None = None):
    from pyspark.sql import SparkSession
    b = (SparkSession.builder.master("local[8]").appName("stamina-check")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in sorted(os.listdir(path)):
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{path}/{t}'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v else 0.0
    return v


def key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def compare(spark, con, name, fn, sql, path):
    t0 = time.time()
    df = fn(spark, path)
    rows = df.collect()
    dt = time.time() - t0
    if sql is None:
        return True, f"rows-only {len(rows)} rows {dt:.1f}s"
    cols = sorted(df.columns)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(dcols) != cols:
        return False, f"columns {cols} vs {sorted(dcols)}"
    a = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=key)
    pos = [dcols.index(c) for c in cols]
    b = sorted((tuple(norm(r[i]) for i in pos) for r in want), key=key)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}; e.g. {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return False, f"{len(bad)}/{len(a)} differ; cols {cols}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}"
    return True, f"{len(a)} rows {dt:.1f}s"


def main():
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    extra = {"stamina.rowsPerSegment": os.environ["SEGMENT"]} if "SEGMENT" in os.environ else None
    spark, con = make_spark(extra), duck(path)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, sqls.get(name), path)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
