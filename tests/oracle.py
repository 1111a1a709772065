"""Compares registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((k, _plain(x)) for k, x in v.items())
    return v


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs between the rows of ``df`` and those of ``sql``; empty if nothing does."""
    res = connect(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    want = sorted(repr([_plain(r[names.index(c)]) for c in order]) for r in res.fetchall())
    got = sorted(repr([_plain(r[c]) for c in order]) for r in (x.asDict(recursive=True) for x in df.collect()))
    out = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    a, b = set(got), set(want)
    return out + [f"only Spark: {x[:300]}" for x in sorted(a - b)[:3]] + [f"only SQL: {x[:300]}" for x in sorted(b - a)[:3]]
