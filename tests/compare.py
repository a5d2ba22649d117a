"""Holds a query's rows against DuckDB's on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in the form that both engines share; floats to 9 digits."""
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{at}{'/*.parquet' if Path(at).is_dir() else ''}'")
    return c


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if rows, names and kinds of columns agree."""
    names = sorted(df.columns)
    r = con.execute(sql)
    theirs = [x[0] for x in r.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    kinds = {x[0]: str(x[1]).lower() for x in r.description}
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean", "float": "float"}
    odd = [(n, t, kinds[n]) for n, t in df.dtypes if t in same and same[t] != kinds[n]]
    at = [theirs.index(n) for n in names]
    right = Counter(tuple(plain(row[k]) for k in at) for row in r.fetchall())
    left = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    if left != right:
        return f"{sum(left.values())} against {sum(right.values())} rows; only here {list((left - right).items())[:2]}; only there {list((right - left).items())[:2]}"[:900]
    return f"kinds {odd}" if odd else ""
