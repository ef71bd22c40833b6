"""Compare a query with its SQL in DuckDB: names, row count and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "is_finite"):  # decimals of DuckDB
        return round(float(v), 5) + 0.0
    return v


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v).__name__ == "str"), v if isinstance(v, str) else (v if v is not None else 0)) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=lambda r: tuple(map(str, r)))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True))]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
