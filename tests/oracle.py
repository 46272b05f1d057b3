"""Runs a registered query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    clean = frame[cols].astype(object).where(frame[cols].notna(), None)

    def text(v):
        if v is None:
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, float):
            return repr(round(v, 6)) if v != int(v) else str(int(v))
        if type(v).__name__.startswith("int"):
            return str(int(v))
        return str(v)

    return cols, sorted(tuple(text(v) for v in r) for r in clean.itertuples(index=False, name=None))


def same(spark, folder, queries, sql, name):
    got = rows(queries[name](spark, folder).toPandas())
    want = rows(connect(folder).sql(sql[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
