"""Side-by-side runs of a query and its SQL twin."""

import decimal
import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in NAMES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr([_plain(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([_plain(r[i]) for i in order] for r in rows)


def both(spark_df, connection, sql):
    """(columns, rows) of each side."""
    rel = connection.sql(sql)
    names = list(rel.columns)
    return (sorted(spark_df.columns), rows_of(spark_df.columns, spark_df.collect())), (sorted(names), rows_of(names, rel.fetchall()))
