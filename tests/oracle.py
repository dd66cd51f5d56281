"""Runs queries beside their DuckDB SQL: the same rows, column names and values, in any order."""

import math
import os
import re

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if re.fullmatch(r"-?\d+(\.\d+)?", str(v)) else str(v)


def same(spark, con, sf, query, sql):
    """Differences in words, none if equal."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    if not got:
        return "no rows"
    off = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(off)} of {len(got)} rows differ, first {off[0]}" if off else ""
