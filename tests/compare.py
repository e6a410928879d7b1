"""Run registered queries next to their SQL and compare all values."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, int):
        return int(v)
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def compare(spark, con, name, entry, sf_dir):
    t = time.time()
    df = entry.build(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if entry.sql is None:
        return "rows-only", len(got), spent, got[:1]
    t = time.time()
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    want, want_cols = rows_of(cols, cur.fetchall())
    sql_spent = time.time() - t
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", len(got), spent, None
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", len(got), spent, None
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        near = all(_near(g, w) for g, w in bad)
        return f"VALUES {len(bad)} differ{' (rounding)' if near else ''}", len(got), spent, bad[:2]
    return "ok" + (f" slow-sql {sql_spent:.1f}" if sql_spent > 5 else ""), len(got), spent, None


def _near(a, b):
    return len(a) == len(b) and all(
        x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x)))
        for x, y in zip(a, b)
    )


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__  # noqa: F401
    from tunedata.plans.registry import QUERIES
    from tunedata.session import build_session

    sf = sys.argv[1]
    names = [n for n in QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    spark = build_session("compare", "local[8]", spark_sql_shuffle_partitions=8, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    failed = []
    for n in names:
        try:
            status, count, spent, detail = compare(spark, con, n, QUERIES[n], sf)
        except Exception as e:  # noqa: BLE001
            status, count, spent, detail = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0, None
        if not status.startswith(("ok", "rows-only")):
            failed.append(n)
        print(f"{n:24s} {status} rows={count} {spent:.2f}s", *( [str(detail)[:900]] if detail and not status.startswith('rows') else []), flush=True)
    print("FAILED", len(failed), failed)
