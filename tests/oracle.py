"""Run registered queries against their SQL counterparts: python -m tests.oracle [sf dir] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


LAST = {"spark": 0.0}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str([plain(x) for x in v.values()])
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(str(plain(row[i])) for i in order) for row in rows)


def compare(spark_df, con, sql) -> str | None:
    t = time.time()
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    LAST["spark"] = time.time() - t
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_cols, want = rows_of(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; only here {sorted(set(got) - set(want))[:2]}; only there {sorted(set(want) - set(got))[:2]}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(diff)} of {len(got)} rows differ, e.g. {got_cols}\n  {diff[0][0]}\n  {diff[0][1]}"
    return None if got else "both empty"


def main() -> None:
    import __spark_entry__ as entry
    from aerolens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, sf), con, oracles[name])
                status = "ok" if problem is None else "DIFF " + problem
            else:
                status = f"rows {fn(spark, sf).count()} (no SQL)"
        except Exception as error:  # noqa: BLE001
            status = "ERROR " + str(error)[:1500]
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name}: {status[:1800]} [{time.time() - t:.1f}s, of it {LAST['spark']:.1f} collecting]", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
