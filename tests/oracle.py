"""Compares a query's rows with its oracle SQL in DuckDB."""
import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() else round(v, 9)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def difference(spark_df, con, sql):
    """None if columns and rows agree; else what differs."""
    res = con.sql(sql)
    names, own = sorted(res.columns), sorted(spark_df.columns)
    if names != own:
        return f"columns {own} against {names}"
    a = Counter(tuple(cell(r[c]) for c in names) for r in spark_df.collect())
    at = [res.columns.index(c) for c in names]
    b = Counter(tuple(cell(r[i]) for i in at) for r in res.fetchall())
    if a == b:
        return None
    return f"{names}: {sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
