"""Rows of a query and of its SQL, made comparable."""

import glob
import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return int(v)
    return v


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_frame(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return [df.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in df.collect()), key=repr)
