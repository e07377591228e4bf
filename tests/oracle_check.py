"""Compare every query with its SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')"
        )
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when columns, kinds of value and rows agree."""
    got_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_rows = result.fetchall()
    columns, got = _rows(df.columns, got_rows)
    want_names, want = _rows(want_columns, want_rows)
    if columns != want_names:
        return f"columns {columns} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    for i, name in enumerate(df.columns):
        j = want_columns.index(name)
        kinds = {type(r[i]) for r in got_rows} - {type(None)}
        wanted = {type(r[j]) for r in want_rows} - {type(None)}
        if kinds != wanted:
            return f"{name}: {kinds} != {wanted}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tillstream.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or [n for n in entry.queries() if n in entry.oracle_sql()]
    spark = build_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
              "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            fault = differences(df, con, sql) if sql else f"no SQL, {df.count()} rows"
            rows = df.count()
        except Exception as error:  # report and go on with the next query
            fault, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += fault is not None
        print(f"{'ok  ' if fault is None else 'FAIL'} {name:22} {rows:7} rows "
              f"{time.time() - began:6.2f}s {fault or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
