"""Rows of a query and of its SQL, in a form that can be compared."""

import decimal
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(str(tuple(map(_plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql(query: str, data: str = DATA) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = con.sql(query)
    columns = sorted(found.columns)
    return columns, Counter(str(tuple(map(_plain, r))) for r in found.select(*[f'"{c}"' for c in columns]).fetchall())
