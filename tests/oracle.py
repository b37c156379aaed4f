"""Compare a query with its SQL, as multisets of rows; doubles at 9 significant digits."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in data)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, cur.fetchall())
    missing, extra = [x for x in b if x not in set(a)][:3], [x for x in a if x not in set(b)][:3]
    assert a == b, f"{name}: {len(a)} and {len(b)} rows; only in SQL {missing}; only in Spark {extra}"
    return len(a)
