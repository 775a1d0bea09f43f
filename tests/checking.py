"""Run a query and its SQL equivalent and compare the rows by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the DataFrame and the SQL result; empty when equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    wanted = canonical(names, result.fetchall())
    got = canonical(df.columns, df.collect())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    for name, kind in df.dtypes:
        expected = kinds.get(types.get(name, ""))
        if expected and expected != kind:
            out.append(f"type of {name}: {kind} against {types[name]}")
        if types.get(name, "").startswith(("HUGEINT", "DECIMAL")):
            out.append(f"type of {name}: {kind} against {types[name]}")
    if len(got) != len(wanted):
        out.append(f"{len(got)} rows against {len(wanted)}")
    if got != wanted:
        bad = [(a, b) for a, b in zip(got, wanted, strict=False) if a != b]
        out.append(f"{len(bad)} rows differ, first {bad[:1]}")
    return out
