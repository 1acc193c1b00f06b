"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(spark_df, con, sql, show=3):
    """Empty list when equal; otherwise a few lines that say what differs."""
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = _rows(dcols, rel.fetchall())
    scols = spark_df.columns
    srows = _rows(scols, spark_df.collect())
    if sorted(scols) != sorted(dcols):
        return [f"columns {sorted(scols)} != {sorted(dcols)}"]
    out = []
    if len(srows) != len(drows):
        out.append(f"rows {len(srows)} != {len(drows)}")
    s, d = list(map(repr, srows)), list(map(repr, drows))
    if s != d:
        only_s = sorted(set(s) - set(d))[:show]
        only_d = sorted(set(d) - set(s))[:show]
        out += [f"spark {x}" for x in only_s] + [f"duck  {x}" for x in only_d]
        if not only_s and not only_d:
            out.append("same distinct rows, different multiplicity")
    return out
