"""Compares a query's rows with those of its oracle SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {path.stem} as select * from read_parquet('{source}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}".replace("-0", "0") if value == 0 else f"{value:.7g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.7g}"
    return str(value)


def ordered(names: list[str], rows: list[tuple]) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in at) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """An account of how the two differ, empty if they agree."""
    names, expected = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} are not {sorted(names)}"
    got, want = ordered(df.columns, [tuple(r) for r in df.collect()]), ordered(names, expected)
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows for {len(want)}; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
