"""Run a registered Spark query and its DuckDB oracle on the same parquet tables and
compare row count, column names and values (order-insensitive)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, sig: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.{sig}g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, sig) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, sig)) for k, x in v.items()))
    return v


def _rows(cols, records, sig):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], sig) for i in order) for r in records]
    return sorted(out, key=lambda r: repr(r))


def compare(spark_df, con, sql: str, sig: int = 9) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    if not res["cols_match"]:
        res["spark_cols"] = sorted(s_cols)
        res["oracle_cols"] = sorted(d_cols)
    if res["cols_match"] and len(s_rows) == len(d_rows):
        a, b = _rows(s_cols, s_rows, sig), _rows(d_cols, d_rows, sig)
        res["values_match"] = a == b
        res["exact_match"] = _rows(s_cols, s_rows, 17) == _rows(d_cols, d_rows, 17)
        if not res["values_match"]:
            diffs = [(x, y) for x, y in zip(a, b) if x != y]
            res["first_diff"] = diffs[:2]
    else:
        res["values_match"] = False
    res["ok"] = res["cols_match"] and res["values_match"] and len(s_rows) == len(d_rows)
    return res
