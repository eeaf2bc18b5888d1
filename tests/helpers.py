"""Comparing a registered query with its SQL on the driver's smallest tables."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder: str = FOLDER):
    c = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        g = p + "/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{g}')")
    return c


def cell(v):
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, folder: str = FOLDER):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connection(folder)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())
