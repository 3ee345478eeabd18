"""Runs registered queries next to their SQL text in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import threading
import time

LIMIT = 60  # seconds for either side of a query
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(((tuple(plain(r[i]) for i in order)) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, build, sql, sf_dir):
    """(ok, message) for one query."""
    t0 = time.time()
    stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    stop.start()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    stop.cancel()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    stop = threading.Timer(LIMIT, con.interrupt)
    stop.start()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    stop.cancel()
    took = f"{t1 - t0:.1f}s/{time.time() - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows {took}"
    in_a, in_b = set(a), set(b)
    diff = [x for x in a if x not in in_b][:2]
    other = [x for x in b if x not in in_a][:2]
    return False, f"{len(a)} vs {len(b)} rows {took}\n   spark {str(diff)[:900]}\n   duck  {str(other)[:900]}"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from skillgrid.session import build_session
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    picks = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf = f"/root/testdata/sf{a[5:]}"
    con, bad = duck(sf), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in queries:
        if picks and not any(name == p or name.startswith(p) for p in picks):
            continue
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), sf)
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + " " + note, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
