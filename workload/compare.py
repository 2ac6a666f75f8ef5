"""Order-free comparison of a Spark result with its SQL check."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [
        tuple(None if pd.isna(v) else (round(float(v), 6) + 0.0 if isinstance(v, float) else (v.item() if hasattr(v, "item") else v)) for v in row)
        for row in df.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(rows: pd.DataFrame, check: str | None, sf_dir: str) -> str | None:
    """None when equal (or unchecked), else what differs first."""
    if check is None:
        return None if len(rows) else "no rows"
    expected = connect(sf_dir).execute(check).fetchdf()
    if sorted(rows.columns) != sorted(expected.columns):
        return f"columns {sorted(rows.columns)} vs {sorted(expected.columns)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows vs {len(expected)}"
    kinds = {c: (rows[c].dtype, expected[c].dtype) for c in rows if rows[c].dtype != expected[c].dtype}
    for got, want in zip(_canonical(rows), _canonical(expected)):
        if got != want:
            return f"first difference {got} vs {want}; kinds {kinds}"
    return f"dtype differences {kinds}" if kinds else None
