"""Runs a query and its SQL side by side on the same tables and compares rows, columns and values."""

import glob
import os
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else f"{value:.9g}"
    if isinstance(value, (pd.Timestamp,)) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, Decimal) or type(value).__name__.startswith("float"):
        return plain(float(value))
    if type(value).__name__.startswith("int") or type(value).__name__.startswith("uint"):
        return str(int(value))
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return str([plain(x) for x in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def difference(df, con, sql):
    """Nothing if both agree, else a short account."""
    (a, left), (b, right) = spark_rows(df), sql_rows(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if left != right:
        only = [x for x in left if x not in set(right)][:3], [x for x in right if x not in set(left)][:3]
        return f"{len(left)} and {len(right)} rows; only Spark {only[0]}; only SQL {only[1]}"
    return ""
