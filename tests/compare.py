"""Runs registered queries in Spark and their SQL in DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def compare(spark, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = _rows(got_cols, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows only: {len(got)}", t1 - t0
    cur = duck(sf_dir).execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = _rows(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}", t1 - t0
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", t1 - t0
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    if bad:
        names = sorted(got_cols)
        g, w = bad[0]
        diff = {n: (a, b) for n, a, b in zip(names, g, w, strict=True) if repr(a) != repr(b)}
        return False, f"{len(bad)} of {len(got)} rows differ, first: {diff}", t1 - t0
    return True, f"{len(got)} rows", t1 - t0


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from riskgraph.session import build

    spark = build("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    sf = argv[0]
    pick = argv[1:]
    qs, os_ = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in qs.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        try:
            ok, msg, sec = compare(spark, fn, os_.get(name), f"/root/testdata/sf{sf}")
        except Exception as exc:
            ok, msg, sec = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {sec:6.1f}s {'' if name in os_ else '(no sql) '}{msg}",
              flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
