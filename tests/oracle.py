"""Compare a registered query with its SQL, as sorted rows with columns sorted by name."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def norm(v):
    if isinstance(v, float):
        assert not math.isnan(v), "a registered result must hold null, not NaN"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(v[i]) for i in order) for v in values), key=repr), sorted(columns)


def from_sql(sql, sf_dir=DATA):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.sql(sql)
    return rows(r.columns, r.fetchall())


def from_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
