"""Runs a query and its SQL over the same Parquet tables and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _key(row):
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty if rows, by sorted columns, are the same."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    want = sorted((_key([dict(zip(names, r))[c] for c in order]) for r in cur.fetchall()), key=repr)
    got = sorted((_key([r[c] for c in order]) for r in df.collect()), key=repr)
    if len(want) != len(got):
        return [f"{len(got)} rows against {len(want)}"]
    return [f"{g} against {w}" for g, w in zip(got, want) if g != w][:3]
