"""Run registered queries and their SQL side by side; used by tests and by hand."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([_plain(v) for v in x])
    return str(x)


def differences(spark_df, con, sql):
    """(rows of Spark, rows of SQL, rows in one only, column names that differ)."""
    names = sorted(spark_df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in names) for r in spark_df.collect())
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return len(mine), None, None, sorted(set(found) ^ set(names))
    at = [found.index(c) for c in names]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())
    a, b = set(mine), set(theirs)
    return len(mine), len(theirs), len(a ^ b), [next(iter(a - b), None), next(iter(b - a), None)]
