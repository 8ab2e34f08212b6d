"""Compare registered queries with their SQL twins on a data folder.

Usage: python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations").split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr))


def compare(spark, con, plan, folder):
    """None when equal, else a description of the difference."""
    frame = plan.run(spark, folder)
    columns, rows = table(frame.columns, [tuple(r) for r in frame.collect()])
    if plan.sql is None:
        return None, len(rows)
    result = con.execute(plan.sql)
    sql_columns, sql_rows = table(
        [d[0] for d in result.description], result.fetchall())
    if columns != sql_columns:
        return f"columns {columns} != {sql_columns}", len(rows)
    if rows != sql_rows:
        left, right = set(rows), set(sql_rows)
        only_spark = sorted(left - right, key=repr)[:3]
        only_sql = sorted(right - left, key=repr)[:3]
        return (
            f"{len(rows)} vs {len(sql_rows)} rows\n   {columns}\n"
            f"   spark {only_spark}\n   sql   {only_sql}"), len(rows)
    return None, len(rows)


def main(argv: list[str]) -> int:
    from docspark.plans import PLANS
    from docspark.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at:at + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    bad = 0
    for name, plan in PLANS.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            problem, count = compare(spark, con, plan, folder)
        except Exception as error:  # report and go on
            problem, count = f"{type(error).__name__}: {str(error)[:1200]}", -1
        spent = time.time() - start
        if problem:
            bad += 1
            print(f"BAD  {name} ({spent:.1f}s): {problem}", flush=True)
        else:
            kind = "ok  " if plan.sql else "rows"
            print(f"{kind} {name} {count} rows {spent:.1f}s", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
