"""Runs registered queries next to their SQL checks: `python -m tests.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from wardline.catalog import ORACLES, QUERIES
from wardline.catalog.registry import BASE
from wardline.session import get_spark


def checking_db(sf_dir: str):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in a canonical order, every value as text."""
    df = df[sorted(df.columns)]
    text = df.apply(lambda s: s.map(lambda x: "∅" if x is None or x is pd.NaT or x != x else str(x)))
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text.columns) else text


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind if df[c].dtype.kind != "M" else "M" for c in sorted(df.columns)}


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None if both give the same columns, kinds and rows; else what differs."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return None if len(got) else "no rows"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(got) and kinds(got) != kinds(want):
        return f"kinds {kinds(got)} != {kinds(want)}"
    a, b = frame(got), frame(want)
    off = (a != b).any(axis=1)
    if off.any():
        return f"{off.sum()} of {len(a)} rows differ, first:\n{a[off].head(3).to_string()}\n{b[off].head(3).to_string()}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = get_spark(f"local[{os.cpu_count()}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = checking_db(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            why = difference(spark, con, sf_dir, name)
        except Exception as exc:  # report and go on to the next query
            why = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += why is not None
        mark = "ok" if why is None else "BAD"
        print(f"{mark:4s}{name:32s}{'sql' if name in ORACLES else 'rows':5s}{time.time() - start:6.1f}s {why or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
