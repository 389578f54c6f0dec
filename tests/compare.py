"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def differences(df, con, sql: str) -> str | None:
    """None if equal, otherwise a short account of the first difference."""
    ours = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = sorted_rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])} rows"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{ours[0]}: {a} != {b}"
    kinds = [
        (c, {type(r[i]).__name__ for r in ours[1][:500]} - {"NoneType"}, {type(r[i]).__name__ for r in theirs[1][:500]} - {"NoneType"})
        for i, c in enumerate(ours[0])
    ]
    off = [k for k in kinds if k[1] != k[2]]
    return f"types {off}" if off else None
