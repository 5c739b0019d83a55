"""Run registered queries next to their checking SQL and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "text")


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None if both hold the same rows in any order, else a short description."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    columns = sorted(left.columns)
    left = left.copy()
    for c in columns:
        # pandas turns whole numbers with nulls into floats
        if left[c].dtype.kind == "f" and right[c].dtype.kind in "iu" and (left[c].dropna() % 1 == 0).all():
            left[c] = left[c].astype("Int64")
        a, b = str(left[c].dtype), str(right[c].dtype)
        if _kind(left[c].dtype) != _kind(right[c].dtype) and len(left):
            return f"column {c}: {a} != {b}"
    a = left[columns].astype(object).where(left[columns].notna(), None)
    b = right[columns].astype(object).where(right[columns].notna(), None)
    rows_a = sorted(map(repr, a.itertuples(index=False, name=None)))
    rows_b = sorted(map(repr, b.itertuples(index=False, name=None)))
    if rows_a != rows_b:
        bad = [(x, y) for x, y in zip(rows_a, rows_b) if x != y]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from flowtide.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            mine = run(spark, folder).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(mine)} rows, {took:.2f}s", flush=True)
                continue
            reason = difference(mine, con.execute(oracles[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            took, reason = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        failed += reason is not None
        print(f"{'FAIL ' if reason else 'ok   '} {name}: {reason or f'{len(mine)} rows'}, {took:.2f}s", flush=True)
    print("failed:", failed)
