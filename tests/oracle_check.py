"""Compare registered queries with their reference SQL: ``python tests/oracle_check.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        if isinstance(v, float) and v == int(v) if isinstance(v, float) and math.isfinite(v) else False:
            return int(v)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if v is not None and type(v).__name__ == "Decimal":
            return float(v)
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def close(a, b, tol):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b if tol == 0 else abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, duck, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    names = df.columns
    got = canon([tuple(r) for r in df.collect()], names)
    t1 = time.time()
    if sql is None:
        return f"rows-only n={len(got)} {t1 - t0:.1f}s", len(got) > 0
    cur = duck.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = canon(cur.fetchall(), want_names)
    t2 = time.time()
    times = f"n={len(got)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(names) != sorted(want_names):
        return f"COLUMNS {sorted(names)} != {sorted(want_names)} {times}", False
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)} {times}", False
    bad = [(g, w) for g, w in zip(got, want) if not all(close(x, y, 0) for x, y in zip(g, w))]
    if bad:
        loose = all(close(x, y, 1e-9) for g, w in bad for x, y in zip(g, w))
        return f"{'INEXACT' if loose else 'VALUES'} {len(bad)} cols={sorted(names)} first {bad[0]} {times}", False
    return f"ok {times}", True


def duck_connection(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main(argv):
    import __spark_entry__ as entry
    from cityloom.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    duck = duck_connection(folder)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            text, ok = compare(spark, duck, name, fn, oracles.get(name), folder)
        except Exception as exc:  # report and go on with the next query
            text, ok = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", False
        print(f"{name}: {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
