"""Compare a Spark result with the rows DuckDB computes from the same files."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        return float(value) + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def _kind(value):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    plain.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return names, plain


def spark_rows(df):
    return normalise(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return normalise([d[0] for d in cursor.description], cursor.fetchall())


def difference(got, want) -> str | None:
    """What differs between two normalised results, or None."""
    (names, rows), (want_names, want_rows) = got, want
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows != {len(want_rows)} rows"
    for a, b in zip(rows, want_rows, strict=True):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            cells = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y or _kind(x) != _kind(y)]
            return f"first difference {cells[:4]} in {a}"
    return None
