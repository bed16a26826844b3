"""Compare named queries with their checking SQL on one directory of tables."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def engine(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal, float)):
        number = float(value)
        return "nan" if number != number else f"{number:.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, run, sql, sf_dir):
    """(message, rows, seconds); the message is empty when both sides agree."""
    start = time.time()
    frame = run(spark, sf_dir)
    got = frame.collect()
    seconds = time.time() - start
    columns, left = rows_of(frame.columns, [tuple(r) for r in got])
    if sql is None:
        return "", len(left), seconds
    cursor = connection.execute(sql)
    names, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} != {names}", len(left), seconds
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} vs {len(right)} rows; spark only {only_left}; sql only {only_right}", len(left), seconds
    return "", len(left), seconds


def main() -> int:
    from tamperlens.plans.catalog import CHECKS, QUERIES
    from tamperlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, connection = local_session(8), engine(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            message, count, seconds = compare(spark, connection, name, run, CHECKS.get(name), sf_dir)
        except Exception as problem:  # report and go on with the next query
            message, count, seconds = f"{type(problem).__name__}: {str(problem)[:700]}", -1, 0.0
        bad += bool(message)
        mark = "FAIL" if message else ("ok" if name in CHECKS else "rows")
        print(f"{mark:5} {name:28} {count:8} rows {seconds:6.2f} s  {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
