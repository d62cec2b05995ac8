"""Runs registered queries and their check SQL side by side, for tests and development."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from parcelry.plans.registry import Query


def sql_rows(sf: str, sql: str) -> pd.DataFrame:
    """The rows of ``sql`` over every table of a folder."""
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con.execute(sql).fetch_df()


def normal(df: pd.DataFrame) -> list[tuple]:
    ordered = df[sorted(df.columns)]
    return sorted(tuple(_cell(value) for value in row) for row in ordered.itertuples(index=False, name=None))


def _cell(value: object) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "∅"
    if isinstance(value, float):
        return f"{value:.9g}" if value != int(value) else str(int(value))
    return str(value)


def differences(spark: SparkSession, sf: str, run: Query, sql: str) -> list[str]:
    """Empty when a query and its SQL agree on columns and rows."""
    got, want = run(spark, sf).toPandas(), sql_rows(sf, sql)
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    left, right = normal(got), normal(want)
    found = [] if len(left) == len(right) else [f"rows {len(left)} != {len(right)}"]
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    if kinds:
        found.append(f"types {kinds}") if any("object" not in pair for pair in kinds.values()) else None
    only = [(a, b) for a, b in zip(left, right) if a != b][:3]
    return found + [f"{a} != {b}" for a, b in only]
