"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else float(v) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


def difference(spark, entry, name: str, sf_dir: str) -> str | None:
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = connection(sf_dir).execute(entry.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        bad = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} and {len(b)} rows; first difference {str(bad)[:600]}"
    return None
