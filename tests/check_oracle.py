"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf_dir] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    expected = con.sql(sql).df()
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} against {sorted(expected.columns)}"
    ours, theirs = rows_of(got), rows_of(expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if ours != theirs:
        differ = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(differ)} of {len(ours)} rows, first {sorted(got.columns)}: {differ[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from conftest import session

    import __spark_entry__ as entry

    spark, con, failed = session(), database(sf_dir), []
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.monotonic()
        try:
            frame = queries[name](spark, sf_dir)
            found = difference(frame, con, oracle[name]) if name in oracle else f"rows only: {frame.count()}"
        except Exception as error:  # report every query, not only the first failure
            found = f"{type(error).__name__}: {str(error)[:600]}"
        good = found is None or found.startswith("rows only")
        failed += [] if good else [name]
        print(f"{name:24s} {time.monotonic() - began:6.1f}s {'ok' if found is None else found}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
