"""Run registered queries in Spark and in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: [(v is None, str(v)) for v in r])


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, str | None]:
    """The number of rows and, if the results differ, what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_columns, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    kinds = {c: KINDS.get(k, k) for c, k in df.dtypes}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    result = con.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = _sorted_rows(list(described), result.fetchall())
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} / {want_columns}"
    if kinds != described:
        differing = {c: (kinds[c], described[c]) for c in kinds if kinds[c] != described[c]}
        return len(got), f"types {differing}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"first difference {a} / {b}"
    return len(got), None


def main() -> int:
    from fleetlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session()
    con = oracle_connection(sf_dir)
    failed = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            rows, difference = compare(spark, con, name, sf_dir)
        except Exception as error:
            rows, difference = -1, "".join(traceback.format_exception_only(error))[:1500]
        failed += difference is not None
        print(f"{'ok  ' if difference is None else 'DIFF'} {name} {rows} {time.time() - started:.1f}s {difference or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
