"""Runs registered queries next to their SQL and reports differences.

Usage: python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    value = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(row[n]) for n in order) for row in rows), key=repr)


def compare(connection, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    spark_rows = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    expected = rows_of(columns, result.fetchall())
    if spark_rows == expected:
        return None if spark_rows else "both are empty"
    only = lambda a, b: sorted(set(map(repr, a)) - set(map(repr, b)))[:3]
    return f"{len(spark_rows)} rows against {len(expected)}: {only(spark_rows, expected)} / {only(expected, spark_rows)}"


def main() -> int:
    import __spark_entry__ as entry

    from tidemark.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, connection = entry.queries(), entry.oracle_sql(), oracle(sf_dir)
    failed = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            problem = compare(connection, queries[name](spark, sf_dir), sql[name]) if name in sql else "no SQL"
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
