"""Hold a query's rows against its SQL in DuckDB, by column names sorted and rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    extra, lost = got[1] - want[1], want[1] - got[1]
    if extra or lost:
        return f"{sum(extra.values())} of {sum(got[1].values())} rows more, {sum(lost.values())} less: {list(extra)[:2]} / {list(lost)[:2]}"
    return "" if got[1] else "no rows"
