"""Compare a DataFrame with DuckDB SQL over the same tables."""

import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(df, columns) -> Counter:
    return Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    expected = Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    got = rows_of(df, columns)
    assert got == expected, (list((got - expected))[:3], list((expected - got))[:3])
