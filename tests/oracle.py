"""Compare a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def _value(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.6g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(x) for x in r) for r in df.itertuples(index=False, name=None))


def expected(folder: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c.execute(sql).df()
