"""Rows of a DataFrame against rows of a SQL text over the same tables."""

from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows(columns, found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr([plain(r[i]) for i in order]) for r in found)


def differences(df, con, sql: str) -> tuple[list, list]:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    return list((ours - theirs).elements())[:5], list((theirs - ours).elements())[:5]
