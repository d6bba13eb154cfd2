"""Rows of a Spark query and of a DuckDB query as comparable, sorted lists."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    if isinstance(v, int):
        return f"{v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
