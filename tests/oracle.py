"""Runs a query and its SQL over the same tables and compares rows as the driver does, about."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{float(v):.6g}" if hasattr(v, "as_tuple") else str(v)


def rows_of(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.sql(sql)
    cols = sorted(r.columns)
    return cols, sorted(tuple(map(norm, x)) for x in r.select(",".join(f'"{x}"' for x in cols)).fetchall())


def same(spark, query, sql: str, sf: str) -> None:
    cols, want = rows_of(sql, sf)
    df = query(spark, sf)
    assert sorted(df.columns) == cols
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want
