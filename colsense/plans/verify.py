"""Local twin of the driver's correctness check: run a registered query on
Spark and its oracle on DuckDB over the same parquet, compare row count,
column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os

import pandas as pd

from colsense.plans.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def frame_hash(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("\x1f".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from colsense.plans.catalog import ORACLES, QUERIES
    s_pdf = QUERIES[name](spark, sf_dir).toPandas()
    out = {"query": name, "spark_rows": len(s_pdf)}
    if name not in ORACLES:
        out["oracle"] = None
        return out
    con = con or duck(sf_dir)
    o_pdf = con.execute(ORACLES[name]).fetchdf()
    sn, sc, sh = frame_hash(s_pdf)
    on, oc, oh = frame_hash(o_pdf)
    out.update(oracle_rows=on, columns_match=sc == oc, hash_match=sh == oh,
               spark_cols=sc, oracle_cols=oc)
    if sh != oh and sc == oc:
        s_set = {tuple(_norm(r[c]) for c in sc) for r in s_pdf.to_dict("records")}
        o_set = {tuple(_norm(r[c]) for c in oc) for r in o_pdf.to_dict("records")}
        out["only_spark"] = sorted(s_set - o_set)[:3]
        out["only_oracle"] = sorted(o_set - s_set)[:3]
    return out
