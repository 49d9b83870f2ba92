"""A query's rows against its DuckDB SQL, as sorted lists of values."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        files = sorted(glob.glob(path + "/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"create view {t} as select * from read_parquet({files})")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def both(df, sql, sf):
    con = connection(sf)
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got, want
