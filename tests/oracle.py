"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    return 0.0 if isinstance(x, float) and x == 0 else x


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql, connection):
    df = query(spark, sf_dir)
    got = counted(df.columns, [tuple(r) for r in df.collect()])
    rel = connection.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    expected = counted(rel.columns, rel.fetchall())
    assert got == expected, (list((got - expected).items())[:2], list((expected - got).items())[:2])
