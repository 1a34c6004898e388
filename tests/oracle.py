"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return _norm(list(v.values()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, len(got), f"rows only, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    odd = [f"{k}:{v}" for k, v in types.items() if v in ("HUGEINT",) or v.startswith("DECIMAL")]
    note = f"{t1 - t0:.1f}s spark, {t2 - t1:.1f}s sql {' '.join(odd)}"
    if a == b:
        return True, len(got), note
    extra, lost = a - b, b - a
    detail = f"{note}; spark {len(got)} sql {len(want)}; only spark {list(extra.items())[:2]}; only sql {list(lost.items())[:2]}"
    return False, len(got), detail


def main():
    from __spark_entry__ import oracle_sql, queries

    from trialsift.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, n, note = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # report and go on
            ok, n, note = False, -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, n, note, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
