"""The comparison of a query with its SQL."""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (bytes, bytearray)):
        return hashlib.md5(bytes(value)).hexdigest()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
