"""Spark-vs-DuckDB parity check, order-insensitive, columns compared by name.

Usage: python -m tests.parity [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

import duckdb

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    canon = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, canon


def _digest(rows) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, key: str, sf_dir: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["oracle"] = None
        return out
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = _canon(s_cols, s_rows)
    dc, dr = _canon(d_cols, d_rows)
    out.update(
        duck_rows=len(d_rows),
        columns_match=sc == dc,
        values_match=_digest(sr) == _digest(dr),
    )
    if not out["columns_match"]:
        out["spark_cols"], out["duck_cols"] = sc, dc
    elif not out["values_match"]:
        ss, ds = set(sr), set(dr)
        out["only_spark"] = [r for r in sr if r not in ds][:3]
        out["only_duck"] = [r for r in dr if r not in ss][:3]
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from sparkmarts.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = local_session()
    con = duck_connection(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for key in keys or list(q):
        r = compare(spark, con, key, sf_dir, q[key], o.get(key))
        ok = r.get("oracle") is None or (r["columns_match"] and r["values_match"]
                                          and r["spark_rows"] == r["duck_rows"])
        bad += not ok
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print(f"{len(keys or q) - bad} ok, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
