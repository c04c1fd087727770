"""Holds a query against its SQL, as rows without order: columns by name, values as text, floats to nine digits."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def compare(df, con, sql: str, may_be_empty: bool = False) -> None:
    """Equal rows, and some: a query that finds nothing proves nothing."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    assert ours or may_be_empty
    different = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not different, (len(different), different[:3])
