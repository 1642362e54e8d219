"""Compares a frame with SQL on the same files, without regard to order; floats to six digits."""

import datetime
import decimal
import math
import os


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def database(path):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(path):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}/{f}'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())
