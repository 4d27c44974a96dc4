"""Run a registered query and its SQL twin, and compare rows after sorting columns by name."""

import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if v is not None else "~"


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in data)


SPARK_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, query, sql):
    """Empty when equal, else a list of differences."""
    df = query(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    s_cols, s_rows = rows_of(df.columns, data)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    d_cols, d_rows = rows_of(names, cur.fetchall())
    problems = []
    if s_cols != d_cols:
        return [f"columns {s_cols} vs {d_cols}"]
    for c, t in df.dtypes:
        if SPARK_KINDS.get(t, t) != kinds[c]:
            problems.append(f"type of {c}: {t} vs {kinds[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems
