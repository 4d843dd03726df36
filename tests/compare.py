"""Order-free comparison of a Spark result with DuckDB's."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v


def rows(frame):
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert [(x, y) for x, y in zip(ra, rb) if x != y][:3] == []
