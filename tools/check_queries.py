"""Run catalog queries and their SQL side by side: ``check_queries.py [folder] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from plenum import build_session  # noqa: E402
from plenum.catalog.registry import entries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        return ("decimal", x)
    if isinstance(x, float):
        return None if math.isnan(x) else ("float", repr(x))
    if isinstance(x, dt.datetime):
        return ("ts", x.replace(tzinfo=None).isoformat())
    if isinstance(x, dt.date):
        return ("date", x.isoformat())
    return x


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str | None:
    """None when both sides agree, else what differs."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    order = sorted(spark_cols)
    a = Counter(tuple(plain(r[spark_cols.index(c)]) for c in order) for r in spark_rows)
    b = Counter(tuple(plain(r[sql_cols.index(c)]) for c in order) for r in sql_rows)
    if a == b:
        return None
    left, right = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(spark_rows)} / {len(sql_rows)}; cols {order}\n    only spark ({sum((a - b).values())}): {str(left)[:900]}\n    only sql ({sum((b - a).values())}): {str(right)[:900]}"


def run(spark, con, folder: str, name: str, pair) -> tuple[str, str | None, float, int]:
    fn, sql = pair
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows-only", None, took, len(rows)
    cur = con.execute(sql)
    sql_cols = [c[0] for c in cur.description]
    problem = compare(rows, df.columns, cur.fetchall(), sql_cols)
    return ("differs" if problem else "same"), problem, took, len(rows)


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(folder), 0
    for name, pair in entries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            state, problem, took, n = run(spark, con, folder, name, pair)
        except Exception as e:  # noqa: BLE001
            state, problem, took, n = "failed", f"{type(e).__name__}: {str(e)[:1500]}", 0.0, -1
        bad += state in ("differs", "failed")
        print(f"{state:10} {name:32} {n:7} rows {took:6.2f}s" + (f"\n    {problem}" if problem else ""), flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
