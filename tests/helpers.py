"""Holds a query against its SQL in DuckDB, as the driver does."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def same_rows(spark, query, sql, sf_dir=SMALL):
    ours = query(spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    theirs = con.execute(sql)
    names = [x[0] for x in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    order = sorted(names)
    want = sorted((tuple(_cell(row[names.index(c)]) for c in order) for row in theirs.fetchall()), key=repr)
    got = sorted((tuple(_cell(row[c]) for c in order) for row in ours.collect()), key=repr)
    assert got == want
