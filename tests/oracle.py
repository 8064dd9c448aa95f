"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(round(v, 6) + 0.0, ".6g")
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


def connect(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(data_dir)):
        if f.endswith(".parquet"):
            path = os.path.join(data_dir, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def compare(df, sql, con):
    """None if rows and names agree, else what differs."""
    run = con.execute(sql)
    theirs, names = [c[0] for c in run.description], sorted(df.columns)
    if sorted(theirs) != names:
        return f"columns {names} vs {sorted(theirs)}"
    at = [theirs.index(c) for c in names]
    b = sorted(tuple(normal(r[i]) for i in at) for r in run.fetchall())
    a = sorted(tuple(normal(v) for v in r) for r in df.select(*names).collect())
    if a == b:
        return None
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows vs {len(b)}; only ours {only[0]}; only SQL {only[1]}"
