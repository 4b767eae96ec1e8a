"""DuckDB text views of the driver tables (the oracle twin of tables.raw_table)."""

from __future__ import annotations

from colsense.plans.tables import DATE_ONLY, ROW_KEYS

# column lists of the tables the typing queries read, with TIMESTAMP columns marked
TABLE_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "labels": ["doc_id", "quality", "toxic"],
}
TIMESTAMPS = {"l_shipdate", "o_orderdate", "ts"}


def text_expr(c: str) -> str:
    if c in TIMESTAMPS:
        fmt = "%Y-%m-%d" if c in DATE_ONLY else "%Y-%m-%d %H:%M:%S.%f"
        return f"strftime({c}, '{fmt}') AS {c}"
    return f"CAST({c} AS VARCHAR) AS {c}"


def text_sql(name: str, cols=None) -> str:
    cols = cols or TABLE_COLUMNS[name]
    keys = ", ".join(ROW_KEYS[name])
    return (f"SELECT CAST(row_number() OVER (ORDER BY {keys}) - 1 AS BIGINT) AS row_id, "
            + ", ".join(text_expr(c) for c in cols) + f" FROM {name}")
