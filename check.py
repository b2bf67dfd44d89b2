"""Compare registered queries with their SQL twins: check.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from folioquery.catalog import all_queries, all_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, NULLs and number types made equal."""

    def plain(value):
        if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
            return None
        if hasattr(value, "item"):
            value = value.item()
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value

    frame = frame[sorted(frame.columns)]
    rows = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, con, folder: str, name: str) -> str:
    """'' when the rows are equal, else what differs."""
    got = all_queries()[name](spark, folder).toPandas()
    sql = all_sql().get(name)
    if sql is None:
        return "" if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normalized(got), normalized(want)
    if a == b:
        return "" if len(a) else "both empty"
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"{len(a)} rows / {len(b)} rows; only Spark {str(only_a)[:600]}; only SQL {str(only_b)[:600]}"


def main() -> None:
    from folioquery.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(all_queries())
    folder = str(Path("/root/testdata") / sf)
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql " if name in all_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
