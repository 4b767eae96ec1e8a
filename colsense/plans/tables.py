"""Driver tables and the text views the typing queries run on.

A "raw" view is what a CSV of the table would hold: every column as text.
Doubles and integers use Spark's own text form; TIMESTAMP columns use a fixed
pattern (date-only columns print as dates).  Each view carries ``row_id`` =
position in key order, so order-dependent operators (chunks, pages, samples)
are deterministic and reproducible by the oracle with ``row_number()``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.operators.rowid import with_row_id

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Unique key giving each table its row order.
ROW_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "labels": ["doc_id"], "documents": ["doc_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
}

# TIMESTAMP columns that hold whole days.
DATE_ONLY = {"o_orderdate", "l_shipdate"}
DATE_PATTERN = "yyyy-MM-dd"
TS_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(field: T.StructField):
    c = F.col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, DATE_PATTERN if field.name in DATE_ONLY else TS_PATTERN)
    return c.cast("string")


def as_text(df: DataFrame, keep=()) -> DataFrame:
    return df.select(*[F.col(f.name) if f.name in keep else text_of(f).alias(f.name)
                       for f in df.schema.fields])


def raw_table(spark: SparkSession, sf_dir: str, name: str, cols=None) -> DataFrame:
    """(row_id, every column as text), row_id in key order."""
    df = load(spark, sf_dir, name)
    if cols is not None:
        df = df.select(*sorted(set(cols) | set(ROW_KEYS[name]), key=df.columns.index))
    numbered = with_row_id(df, order_by=ROW_KEYS[name])
    wanted = [c for c in df.columns if cols is None or c in cols]
    return as_text(numbered.select("row_id", *wanted), keep=("row_id",))


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Every column as text, no row id (for order-free operators)."""
    return as_text(load(spark, sf_dir, name))
