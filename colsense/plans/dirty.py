"""Deterministic dirty text derived from the driver tables.

Each dirty column picks a variant by ``key % len(variants)``; a variant is a
list of pieces, each a literal or ``{name}`` of a base expression.  The same
spec renders to a Spark Column and to DuckDB SQL, so both sides of the
oracle check see identical text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.functions.vocab import DAY_WORDS
from colsense.plans.sqlflags import q

_WORDS = list(DAY_WORDS)


# name -> DuckDB SQL of a base piece over the orders table
BASE_SQL = {
    "p": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)",
    "c": "format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2)))",
    "cents": "CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR)",
    "kmod": "CAST(o_orderkey % 100 AS VARCHAR)",
    "k": "CAST(o_orderkey AS VARCHAR)",
    "m": "CAST(o_custkey AS VARCHAR)",
    "w": "CAST(o_orderkey % 30 AS VARCHAR)",
    "wword": "([" + ", ".join(q(x) for x in _WORDS) + "])[o_orderkey % 30 % 11 + 1]",
    "d_iso": "strftime(o_orderdate, '%Y-%m-%d')",
    "d_mdy": "strftime(o_orderdate, '%m/%d/%Y')",
    "d_dmy": "strftime(o_orderdate, '%d/%m/%Y')",
    "d_dmon": "strftime(o_orderdate, '%-d %b %Y')",
    "d_mond": "strftime(o_orderdate, '%b %-d, %Y')",
    "d_t": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')",
    "prio": "o_orderpriority",
}


def _spark_base() -> dict[str, Column]:
    """The same base pieces as Spark Columns."""
    p2 = F.col("o_totalprice").cast("decimal(18,2)")
    d = F.col("o_orderdate")
    w = F.col("o_orderkey") % 30
    return {
        "p": p2.cast("string"),
        "c": F.format_number(p2, 2),
        "cents": (p2 * 100).cast("bigint").cast("string"),
        "kmod": (F.col("o_orderkey") % 100).cast("string"),
        "k": F.col("o_orderkey").cast("string"),
        "m": F.col("o_custkey").cast("string"),
        "w": w.cast("string"),
        "wword": F.element_at(F.array(*[F.lit(x) for x in _WORDS]), (w % 11 + 1).cast("int")),
        "d_iso": F.date_format(d, "yyyy-MM-dd"),
        "d_mdy": F.date_format(d, "MM/dd/yyyy"),
        "d_dmy": F.date_format(d, "dd/MM/yyyy"),
        "d_dmon": F.date_format(d, "d MMM yyyy"),
        "d_mond": F.date_format(d, "MMM d, yyyy"),
        "d_t": F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"),
        "prio": F.col("o_orderpriority"),
    }


# column -> variants (chosen by o_orderkey % number of variants)
ORDERS_DIRTY = {
    "price": [["N/A"], ["--"], ["$", "{c}"], ["{p}", " €"], ["-", "{p}", "€"], ["{kmod}", "%"],
              ["{cents}", "e-2"], [" ", "{p}", " "], ["{p}"], ["NULL"], ["1.", "{c}"], ["£ ", "{p}"]],
    "note": [["NA"], ["Not   Available"], ["n/a"], ["  "], ["?"], ["pending"], ["TBD"], [" NA "],
             ["unknown"], ["note ", "{k}"]],
    "amount": [["{k}", "+", "{m}", "i"], ["{k}"], ["{m}", "j"], ["(", "{k}", "-", "{m}", "j)"],
               ["{k}", " + ", "{m}", "i"]],
    "ordered_on": [["{d_iso}"], ["{d_mdy}"], ["{d_dmy}"], ["{d_dmon}"], ["{d_mond}"], ["{d_t}"],
             ["not a date"]],
    "wait": [["P", "{w}", "D"], ["{w}", " days"], ["{w}", "d"], ["{wword}"]],
    "flag": [["{flag}"]],
    "prio": [["{prio}"]],
}
FLAG_MAP = {"F": "yes", "O": " No ", "P": "TRUE"}

_PIECE = re.compile(r"^\{(\w+)\}$")


def _render_spark(variant, base) -> Column:
    parts = [base[m.group(1)] if (m := _PIECE.match(p)) else F.lit(p) for p in variant]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _render_sql(variant, base) -> str:
    parts = [base[m.group(1)] if (m := _PIECE.match(p)) else q(p) for p in variant]
    return "(" + " || ".join(parts) + ")"


def dirty_column_spark(name: str, key: Column) -> Column:
    base = _spark_base()
    base["flag"] = F.element_at(F.create_map(*[F.lit(x) for kv in FLAG_MAP.items() for x in kv]),
                                F.col("o_orderstatus"))
    variants = ORDERS_DIRTY[name]
    expr = None
    for i, v in enumerate(variants):
        cond = (key % len(variants)) == i
        expr = F.when(cond, _render_spark(v, base)) if expr is None else expr.when(cond, _render_spark(v, base))
    return expr


def dirty_column_sql(name: str, key: str = "o_orderkey") -> str:
    base = dict(BASE_SQL)
    base["flag"] = "(CASE o_orderstatus " + " ".join(
        f"WHEN {q(k)} THEN {q(v)}" for k, v in FLAG_MAP.items()) + " END)"
    variants = ORDERS_DIRTY[name]
    return ("(CASE " + " ".join(f"WHEN {key} % {len(variants)} = {i} THEN {_render_sql(v, base)}"
                                for i, v in enumerate(variants)) + " END)")


DIRTY_COLUMNS = list(ORDERS_DIRTY)


def dirty_orders(orders: DataFrame) -> DataFrame:
    """(o_orderkey, price, note, amount, ordered_on, wait, flag, prio) - all text but the key."""
    key = F.col("o_orderkey")
    return orders.select("o_orderkey", *[dirty_column_spark(c, key).alias(c) for c in DIRTY_COLUMNS])


def dirty_orders_sql() -> str:
    cols = ", ".join(f"{dirty_column_sql(c)} AS {c}" for c in DIRTY_COLUMNS)
    return f"SELECT o_orderkey, {cols} FROM orders"
