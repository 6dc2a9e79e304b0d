"""Compare query results with DuckDB on the same Parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duckdb_views(sf_dir: str):
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return repr(value)


def bag(columns, rows) -> Counter:
    """Rows as a bag, columns sorted by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str, shown: int = 4) -> str | None:
    """None when equal, else a short report."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = bag(names, result.fetchall())
    found = bag(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if found == expected:
        return None
    extra, missing = found - expected, expected - found
    return (
        f"{sum(found.values())} rows instead of {sum(expected.values())}; "
        f"{sum(extra.values())} extra {list(extra)[:shown]}; {sum(missing.values())} missing {list(missing)[:shown]}"
    )
