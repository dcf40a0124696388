"""Rows of a Spark query and of its DuckDB SQL, in a common form."""

import datetime
import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def both(spark, folder, query, sql, con):
    df = query(spark, folder)
    assert df.inputFiles() or "mailbox" in df._jdf.queryExecution().toString(), "the query reads no table"  # pages of a mailbox are no files to Spark
    got = in_order(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    return got, in_order([d[0] for d in res.description], res.fetchall())
