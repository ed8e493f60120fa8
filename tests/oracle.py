"""Run registered queries against their SQL in DuckDB and compare all rows.

    python tests/oracle.py [--dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from catalens.session import local_session  # noqa: E402
from catalens.workload.fixtures import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_value(row[i]) for i in order) for row in rows], key=repr)


def compare(spark, connection, folder: str, name: str, frame=None) -> str | None:
    """None if equal, else what differs."""
    frame = frame if frame is not None else entry.queries()[name](spark, folder)
    rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if not wanted:
        return "oracle has no rows"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows != {len(wanted)}; first {rows[:1]} / {wanted[:1]}"
    for got, want in zip(rows, wanted):
        if got != want:
            return f"got {got}\n   want {want}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, connection = local_session(), connect(args.dir)
    failed = 0
    for name in args.names or list(entry.queries()):
        start = time.time()
        try:
            problem = compare(spark, connection, args.dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind}" + (f"\n   {problem}" if problem else ""), flush=True)
        failed += problem is not None
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
