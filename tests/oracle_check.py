"""Compare registered queries with their SQL on one scale. `python tests/oracle_check.py [names]`."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def clean(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return v
    return f"<{type(v).__name__}> {v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(clean(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def compare(con, spark, query, folder) -> str | None:
    """None when both agree, else what differs."""
    df = query.run(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None
    cur = con.execute(query.sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        for n, x, y in zip(got_names, a, b):
            if x != y or type(x) is not type(y):
                return f"{n}: {x!r} against {y!r} in {a} / {b}"
    return None if got or query.name in ALLOWED_EMPTY else "no rows"


ALLOWED_EMPTY: set[str] = set()


def main(argv):
    from grainwise.plans import load
    from grainwise.session import local_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    catalogue = load()
    names = [n for n in catalogue if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    for name in names:
        began = time.time()
        try:
            wrong = compare(con, spark, catalogue[name], folder)
        except Exception as e:
            wrong = "".join(traceback.format_exception_only(e)).strip()[:700] + " @ " + " < ".join(
                f"{f.name}:{f.lineno}" for f in traceback.extract_tb(e.__traceback__)[::-1][:40]
                if "grainwise" in f.filename)[:300]
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'BAD '} {name:28s} {time.time() - began:6.2f}s"
              f"{'' if catalogue[name].sql else '  (rows only)'}{'' if wrong is None else '  ' + wrong}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
