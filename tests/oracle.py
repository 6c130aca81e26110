"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([c[0] for c in cur.description], cur.fetchall())


def differences(spark, con, sf_dir, fn, sql, show=3):
    names, got = spark_rows(fn(spark, sf_dir))
    expected_names, expected = sql_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}: {(got[:1], expected[:1])!r:.800}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e or list(map(type, g)) != list(map(type, e))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: " + "\n".join(f"{b!r:.1500}" for b in bad[:show])
    return None
