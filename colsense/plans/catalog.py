"""The registered driver queries: each key has a Spark plan and, where SQL can
express it, a DuckDB oracle.  Every query reads the driver tables (or text
that Spark derives from them) in full.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.functions import vocab as V
from colsense.functions.boolean import render_bool, to_bool
from colsense.functions.datetime import to_datetime
from colsense.functions.duration import duration_days, interval_seconds
from colsense.functions.missing import is_missing_pattern, is_missing_token
from colsense.functions.numeric import numeric_parts, separators, strip_currency
from colsense.functions.text import guarded_double, norm
from colsense.operators.chunks import chunk_errors, chunk_types, merge_chunk_types
from colsense.operators.convert import (category_codes, category_dictionary, coerced_counts, convert, convert_counted,
                                        errors_frame)
from colsense.operators.dictionary import extend_dictionary, read_dictionary
from colsense.operators.infer import decide, infer_types
from colsense.operators.numbered import read_page, write_numbered
from colsense.operators.paging import page, page_count, preview_bool, preview_json
from colsense.operators.profile import profile
from colsense.operators.rowid import with_row_id
from colsense.plans import sqlflags as S
from colsense.plans.dirty import DIRTY_COLUMNS, dirty_orders, dirty_orders_sql
from colsense.plans.tables import load, raw_table, text_table
from colsense.plans.textsql import TABLE_COLUMNS, text_sql
from colsense.sources.csv import dropped_rows, read_csv, write_csv
from colsense.sources.encoding import audit_encodings
from colsense.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHUNK_ROWS = 2000
PAGE, PAGE_SIZE = 3, 25


def register(name: str, sql: str | None = None):
    """Record the oracle now; the returned decorator records the Spark query."""
    if sql is not None:
        ORACLES[name] = sql

    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --------------------------------------------------------------- shared inputs

def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty orders text with row_id in o_orderkey order."""
    return with_row_id(dirty_orders(load(spark, sf_dir, "orders")), order_by=["o_orderkey"])


DIRTY_SQL = (f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, * "
             f"FROM ({dirty_orders_sql()})")


def _profile_of(spark, sf_dir, table):
    return profile(text_table(spark, sf_dir, table))


def _profile_sql(table):
    return S.profile_sql(text_sql(table), TABLE_COLUMNS[table])


def _dirty_profile(spark, sf_dir, overrides=None):
    return profile(dirty_orders(load(spark, sf_dir, "orders")), DIRTY_COLUMNS, overrides=overrides)


DIRTY_PROFILE_SQL = S.profile_sql(DIRTY_SQL, DIRTY_COLUMNS)

# --------------------------------------------------------------- profile (A1-A10)

register("profile_counts", f"SELECT \"column\", position, n_rows, n_missing, n_non_null FROM ({_profile_sql('lineitem')})")(
    lambda spark, d: _profile_of(spark, d, "lineitem").select("column", "position", "n_rows", "n_missing", "n_non_null"))

register("profile_numeric_ratio", f"SELECT \"column\", n_numeric, n_numeric / n_non_null AS numeric_ratio FROM ({_profile_sql('lineitem')})")(
    lambda spark, d: _profile_of(spark, d, "lineitem").select(
        "column", "n_numeric", (F.col("n_numeric") / F.col("n_non_null")).alias("numeric_ratio")))

register("profile_distinct", f"SELECT \"column\", n_distinct, n_distinct / n_rows AS distinct_ratio FROM ({_profile_sql('lineitem')})")(
    lambda spark, d: _profile_of(spark, d, "lineitem").select(
        "column", "n_distinct", (F.col("n_distinct") / F.col("n_rows")).alias("distinct_ratio")))

_MR, _MC = S.category_limits_sql("n_rows")
register("profile_categorical",
         f"SELECT \"column\", n_rows, n_distinct, CAST({_MR} AS DOUBLE) AS max_ratio, CAST({_MC} AS INTEGER) AS max_count, "
         f"(n_distinct / n_rows <= {_MR} OR n_distinct <= {_MC}) AS is_category FROM ({_profile_sql('lineitem')})")


@register("profile_categorical")
def _profile_categorical(spark, d):
    from colsense.operators.infer import category_limits
    p = _profile_of(spark, d, "lineitem")
    mr, mc = category_limits(F.col("n_rows"))
    return p.select("column", "n_rows", "n_distinct", mr.cast("double").alias("max_ratio"),
                    mc.cast("int").alias("max_count"),
                    ((F.col("n_distinct") / F.col("n_rows") <= mr) | (F.col("n_distinct") <= mc))
                    .alias("is_category"))


register("int_vs_float", f"SELECT \"column\", n_numeric, all_integral FROM ({_profile_sql('lineitem')})")(
    lambda spark, d: _profile_of(spark, d, "lineitem").select("column", "n_numeric", "all_integral"))

register("profile_complex", f"SELECT \"column\", n_numeric, any_complex FROM ({DIRTY_PROFILE_SQL})")(
    lambda spark, d: _dirty_profile(spark, d).select("column", "n_numeric", "any_complex"))

register("profile_duration", f"SELECT \"column\", n_duration, n_duration / n_non_null AS duration_ratio FROM ({DIRTY_PROFILE_SQL})")(
    lambda spark, d: _dirty_profile(spark, d).select(
        "column", "n_duration", (F.col("n_duration") / F.col("n_non_null")).alias("duration_ratio")))

register("profile_datetime", f"SELECT \"column\", n_datetime, n_datetime / n_non_null AS datetime_ratio FROM ({DIRTY_PROFILE_SQL})")(
    lambda spark, d: _dirty_profile(spark, d).select(
        "column", "n_datetime", (F.col("n_datetime") / F.col("n_non_null")).alias("datetime_ratio")))

register("missing_counts", f"SELECT \"column\", n_rows, n_missing FROM ({DIRTY_PROFILE_SQL})")(
    lambda spark, d: _dirty_profile(spark, d).select("column", "n_rows", "n_missing"))

register("profile_bool", f"SELECT \"column\", all_bool FROM ({_profile_sql('labels')})")(
    lambda spark, d: _profile_of(spark, d, "labels").select("column", "all_bool"))

# --------------------------------------------------------------- inference

_INFER_COLS = ["column", "position", "inferred_type", "n_rows", "n_non_null", "n_distinct", "n_numeric"]
_INFER_SQL = ", ".join('"column"' if c == "column" else c for c in _INFER_COLS)


def _infer_sql(table):
    return f"SELECT {_INFER_SQL} FROM ({S.decide_sql(_profile_sql(table))})"


def _infer_query(table):
    def run(spark, d):
        return infer_types(text_table(spark, d, table)).select(*_INFER_COLS)
    return run


for _t in ["lineitem", "orders", "events", "labels", "part"]:
    register(f"infer_types_{_t}", _infer_sql(_t))(_infer_query(_t))

register("infer_types_dirty", f"SELECT {_INFER_SQL} FROM ({S.decide_sql(DIRTY_PROFILE_SQL)})")(
    lambda spark, d: infer_types(_dirty(spark, d), cols=DIRTY_COLUMNS).select(*_INFER_COLS))

register("type_labels",
         "SELECT \"column\", inferred_type, CASE inferred_type "
         + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in V.TYPE_LABELS.items())
         + f" ELSE inferred_type END AS label FROM ({S.decide_sql(_profile_sql('orders'))})")(
    lambda spark, d: infer_types(text_table(spark, d, "orders")).select("column", "inferred_type", "label"))

# --------------------------------------------------------------- scalar cleaners on dirty orders

_NUM = S.numeric_cte("(" + DIRTY_SQL.replace("SELECT CAST", "SELECT price AS value, CAST", 1) + ")")


def _dirty(spark, d):
    return dirty_orders(load(spark, d, "orders"))


register("missing_exact",
         f"SELECT o_orderkey, note, note IN {S.in_list(V.ALL_MISSING_TOKENS)} AS is_token FROM ({dirty_orders_sql()})")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "note", is_missing_token("note").alias("is_token")))

register("missing_pattern",
         f"SELECT o_orderkey, note, regexp_matches(note, {S.q(S.MISSING_RE2)}) AS is_pattern FROM ({dirty_orders_sql()})")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "note", is_missing_pattern("note").alias("is_pattern")))

register("clean_currency", f"SELECT o_orderkey, price, _t AS stripped FROM {_NUM}")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "price", strip_currency(norm("price")).alias("stripped")))

register("clean_percent",
         f"SELECT o_orderkey, price, CASE WHEN _pct THEN {S.fdouble('rtrim(_t, ' + S.q('%') + ')')} / 100.0 END AS pct FROM {_NUM}")


@register("clean_percent")
def _clean_percent(spark, d):
    t = strip_currency(norm("price"))
    return _dirty(spark, d).select(
        "o_orderkey", "price",
        F.when(t.endswith("%"), guarded_double(F.regexp_replace(t, "%+$", "")) / 100.0).alias("pct"))


register("clean_scientific", f"SELECT o_orderkey, price, CASE WHEN _sci THEN {S.fdouble('_t')} END AS sci FROM {_NUM}")(
    lambda spark, d: _dirty(spark, d).select(
        "o_orderkey", "price",
        F.when(strip_currency(norm("price")).contains("e"), guarded_double(strip_currency(norm("price")))).alias("sci")))

register("clean_separators", f"SELECT o_orderkey, price, _plain AS plain FROM {_NUM}")(
    lambda spark, d: _dirty(spark, d).select(
        "o_orderkey", "price", separators(strip_currency(norm("price"))).alias("plain")))

register("clean_numeric_mixed", f"SELECT o_orderkey, price, num_value AS value FROM {_NUM}")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "price", numeric_parts("price")["value"].alias("value")))

_CPLX = S.numeric_cte("(" + DIRTY_SQL.replace("SELECT CAST", "SELECT amount AS value, CAST", 1) + ")")
register("clean_complex", f"SELECT o_orderkey, amount, cplx, re, im FROM {_CPLX}")


@register("clean_complex")
def _clean_complex(spark, d):
    p = numeric_parts("amount")
    return _dirty(spark, d).select("o_orderkey", "amount", p["cplx"].alias("cplx"), p["re"].alias("re"),
                                   p["im"].alias("im"))


register("bool_map", f"SELECT o_orderkey, flag, {S.bool_value('flag')} AS b FROM ({dirty_orders_sql()})")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "flag", to_bool("flag").alias("b")))

_DUR = S.numeric_cte("(" + DIRTY_SQL.replace("SELECT CAST", "SELECT wait AS value, CAST", 1) + ")")
register("duration_days", f"SELECT o_orderkey, wait, CASE WHEN NOT isnan(dur_days) THEN dur_days END AS days FROM {_DUR}")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "wait", duration_days("wait").alias("days")))

register("datetime_formats", f"SELECT o_orderkey, ordered_on, {S.datetime_value('ordered_on')} AS ts FROM ({dirty_orders_sql()})")(
    lambda spark, d: _dirty(spark, d).select("o_orderkey", "ordered_on", to_datetime("ordered_on").alias("ts")))

# --------------------------------------------------------------- conversion

def _converted(spark, d, table):
    raw = raw_table(spark, d, table)
    types = infer_types(raw, row_id="row_id")
    return convert(raw, types, keep=["row_id"])


def _convert_sql(table, typed: dict[str, str]) -> str:
    """Direct casts of the text view to the types the cascade picks."""
    cols = []
    for c, t in typed.items():
        if t == V.INT:
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
        elif t == V.FLOAT:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif t == V.DATETIME:
            cols.append(f"{S.datetime_value(c)} AS {c}")
        else:
            cols.append(c)
    return f"SELECT row_id, {', '.join(cols)} FROM ({text_sql(table)})"


# The conversion oracles cast to the types the cascade decides at sf0.01 (the
# scale of the correctness check; SQL cannot choose a column's type from data).
# The Spark side infers them; infer_types_orders/_events check that decision.
ORDERS_TYPES_SF001 = {"o_orderkey": V.INT, "o_custkey": V.INT, "o_orderstatus": V.CATEGORY,
                      "o_totalprice": V.FLOAT, "o_orderdate": V.DATETIME, "o_orderpriority": V.CATEGORY}
EVENTS_TYPES = {"event_id": V.INT, "ts": V.DATETIME, "user_id": V.INT, "event_type": V.CATEGORY,
                "value": V.FLOAT, "props": V.CATEGORY}

register("convert_orders", _convert_sql("orders", ORDERS_TYPES_SF001))(
    lambda spark, d: _converted(spark, d, "orders"))
register("convert_events", _convert_sql("events", EVENTS_TYPES))(
    lambda spark, d: _converted(spark, d, "events"))

# --------------------------------------------------------------- overrides

register("override_numeric",
         f"SELECT o_orderkey, {S.fdouble('price')} AS price, "
         f"CAST(CASE WHEN {S.fdouble('amount')} = floor({S.fdouble('amount')}) THEN CAST({S.fdouble('amount')} AS BIGINT) END AS VARCHAR) AS amount "
         f"FROM ({dirty_orders_sql()})")


@register("override_numeric")
def _override_numeric(spark, d):
    raw = _dirty(spark, d).select("o_orderkey", "price", "amount")
    ov = {"price": V.FLOAT, "amount": V.INT}
    types = infer_types(raw, overrides=ov, cols=["price", "amount"])
    out = convert(raw, types, keep=["o_orderkey"])
    # nullable BIGINT exported as text: pandas would turn it into float
    return out.select("o_orderkey", "price", F.col("amount").cast("string").alias("amount"))


register("override_duration",
         f"SELECT o_orderkey, CASE WHEN NOT isnan(dur_days) THEN dur_days * 86400 END AS wait_seconds FROM "
         + S.numeric_cte(f"(SELECT o_orderkey, wait AS value FROM ({dirty_orders_sql()}))"))


@register("override_duration")
def _override_duration(spark, d):
    raw = _dirty(spark, d).select("o_orderkey", "wait")
    types = infer_types(raw, overrides={"wait": V.DURATION}, cols=["wait"])
    out = convert(raw, types, keep=["o_orderkey"])
    return out.select("o_orderkey", interval_seconds(F.col("wait")).alias("wait_seconds"))


_STRICT = {"ordered_on": V.DATETIME, "flag": V.BOOL, "prio": "int64", "amount": V.COMPLEX}
_STRICT_FAIL = {
    "ordered_on": S.override_fails_sql("value", V.DATETIME),
    "flag": S.override_fails_sql("value", V.BOOL),
    "prio": S.override_fails_sql("value", "int64"),
    "amount": S.override_fails_sql("value", V.COMPLEX),
}
_STRICT_COLS = list(_STRICT)
_STRICT_TYPES_SQL = S.decide_sql(S.profile_sql(DIRTY_SQL, _STRICT_COLS, override_fail=_STRICT_FAIL), _STRICT)

register("override_strict",
         f"SELECT \"column\", requested_type, override_failed, n_override_fail, inferred_type FROM ({_STRICT_TYPES_SQL})")(
    lambda spark, d: infer_types(dirty_raw(spark, d), overrides=_STRICT, cols=_STRICT_COLS)
    .select("column", "requested_type", "override_failed", "n_override_fail", "inferred_type"))

register("override_complex",
         f"SELECT \"column\", requested_type, override_failed, inferred_type FROM ({_STRICT_TYPES_SQL}) WHERE \"column\" = 'amount'")(
    lambda spark, d: infer_types(dirty_raw(spark, d), overrides=_STRICT, cols=_STRICT_COLS)
    .where(F.col("column") == "amount").select("column", "requested_type", "override_failed", "inferred_type"))


def _samples_sql(cols_fail: dict[str, str]) -> str:
    parts = []
    for c, pred in cols_fail.items():
        parts.append(f"""SELECT {S.q(c)} AS "column", string_agg(value, '|' ORDER BY row_id) AS samples FROM
            (SELECT row_id, {c} AS value FROM ({DIRTY_SQL})
             WHERE {c} IS NOT NULL AND {c} NOT IN {S.in_list(V.READER_NULL_TOKENS)}
             ORDER BY row_id LIMIT {V.ERROR_SAMPLE_SIZE})""")
    return " UNION ALL ".join(parts)


_FAILING = {c: p for c, p in _STRICT_FAIL.items() if c in ("ordered_on", "prio", "amount")}


def _errors(spark, d):
    raw = dirty_raw(spark, d)
    types = infer_types(raw, overrides=_STRICT, cols=_STRICT_COLS, row_id="row_id")
    return errors_frame(raw, types, _STRICT, "row_id")


register("error_samples", _samples_sql(_FAILING))(
    lambda spark, d: _errors(spark, d).select("column", F.array_join("sample_values", "|").alias("samples")))

register("override_errors",
         f"""SELECT t."column", t.requested_type,
                    'could not convert ' || CAST(t.n_override_fail AS VARCHAR) || ' value(s) to ' || t.requested_type AS error,
                    s.samples
             FROM ({_STRICT_TYPES_SQL}) t JOIN ({_samples_sql(_FAILING)}) s ON t."column" = s."column"
             WHERE t.override_failed""")(
    lambda spark, d: _errors(spark, d).select("column", "requested_type", "error",
                                             F.array_join("sample_values", "|").alias("samples")))

# --------------------------------------------------------------- row ids and pages

register("row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id FROM orders")(
    lambda spark, d: with_row_id(load(spark, d, "orders").select("o_orderkey"), order_by=["o_orderkey"]))

register("page_orders",
         f"SELECT * FROM ({_convert_sql('orders', ORDERS_TYPES_SF001)}) "
         f"WHERE row_id >= {(PAGE - 1) * PAGE_SIZE} AND row_id < {PAGE * PAGE_SIZE}")(
    lambda spark, d: page(_converted(spark, d, "orders"), PAGE, PAGE_SIZE))

_BY_PRIORITY = "o_orderpriority, o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderdate"


@register("page_numbered",
          f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {_BY_PRIORITY}) - 1 AS BIGINT) AS row_id, {_BY_PRIORITY} FROM orders) "
          f"WHERE row_id >= {(PAGE - 1) * PAGE_SIZE} AND row_id < {PAGE * PAGE_SIZE}")
def _page_numbered(spark, d):
    """A page of orders by a key with many ties, read from the files of a numbered table that hold it."""
    path = scratch_path(spark, "numbered")
    columns = _BY_PRIORITY.split(", ")
    write_numbered(load(spark, d, "orders").select(*columns), path, columns[:1])
    return read_page(spark, path, PAGE, PAGE_SIZE)


_SIZES = [10, 25, 50, 100]
register("page_count",
         " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS page_size, CAST(count(*) AS BIGINT) AS total_rows, "
                            f"CAST(ceil(count(*) / {s}) AS BIGINT) AS page_count FROM orders" for s in _SIZES))


@register("page_count")
def _page_count(spark, d):
    total = load(spark, d, "orders").agg(F.count(F.lit(1)).alias("total_rows"))
    sized = [F.struct(F.lit(s).cast("long").alias("page_size"), page_count(F.col("total_rows"), s).alias("page_count")) for s in _SIZES]
    return total.select("total_rows", F.inline(F.array(*sized)))


register("preview_bool",
         "SELECT row_id, doc_id, CASE WHEN quality = '1' THEN 'True' WHEN quality = '0' THEN 'False' END AS quality, "
         "CASE WHEN toxic = '1' THEN 'True' WHEN toxic = '0' THEN 'False' END AS toxic "
         f"FROM ({text_sql('labels')})")(
    lambda spark, d: preview_bool(_converted(spark, d, "labels")).select("row_id", F.col("doc_id").cast("string").alias("doc_id"),
                                                         "quality", "toxic"))

register("preview_json",
         "SELECT row_id, CAST(json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, "
         "'o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice, "
         "'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'), "
         f"'o_orderpriority', o_orderpriority) AS VARCHAR) AS json FROM ({_convert_sql('orders', ORDERS_TYPES_SF001)})")(
    lambda spark, d: preview_json(_converted(spark, d, "orders")))

# --------------------------------------------------------------- chunks

def _chunk_types(spark, d, overrides=None):
    return chunk_types(dirty_raw(spark, d), "row_id", CHUNK_ROWS, overrides=overrides, cols=DIRTY_COLUMNS)


_CHUNK_PROFILE = S.profile_sql(f"SELECT *, CAST(floor(row_id / {CHUNK_ROWS}) AS BIGINT) AS chunk_id FROM ({DIRTY_SQL})",
                               DIRTY_COLUMNS, group="chunk_id")
register("chunk_types", f"SELECT chunk_id, \"column\", inferred_type FROM ({S.decide_sql(_CHUNK_PROFILE)})")(
    lambda spark, d: _chunk_types(spark, d).select("chunk_id", "column", "inferred_type"))

register("chunk_types_merged",
         f"SELECT \"column\", CASE WHEN count(DISTINCT inferred_type) = 1 THEN max(inferred_type) ELSE 'object' END AS inferred_type "
         f"FROM ({S.decide_sql(_CHUNK_PROFILE)}) GROUP BY \"column\"")(
    lambda spark, d: merge_chunk_types(_chunk_types(spark, d)).select("column", "inferred_type"))

_CHUNK_OV = {"ordered_on": V.DATETIME, "prio": "int64"}
_CHUNK_OV_PROFILE = S.profile_sql(
    f"SELECT *, CAST(floor(row_id / {CHUNK_ROWS}) AS BIGINT) AS chunk_id FROM ({DIRTY_SQL})", DIRTY_COLUMNS,
    group="chunk_id", override_fail={c: _STRICT_FAIL[c] for c in _CHUNK_OV})
_CHUNK_VALUES = " UNION ALL ".join(
    f'SELECT row_id, CAST(floor(row_id / {CHUNK_ROWS}) AS BIGINT) AS chunk_id, {S.q(c)} AS "column", {c} AS value '
    f"FROM ({DIRTY_SQL})" for c in _CHUNK_OV)
register("chunk_errors_merged", f"""
    WITH prof AS ({S.decide_sql(_CHUNK_OV_PROFILE, _CHUNK_OV)}),
    last AS (SELECT "column", max(chunk_id) AS chunk_id FROM prof WHERE override_failed GROUP BY "column"),
    vals AS (SELECT *, row_number() OVER (PARTITION BY "column", chunk_id ORDER BY row_id) AS rn
             FROM ({_CHUNK_VALUES}) WHERE value IS NOT NULL AND value NOT IN {S.in_list(V.READER_NULL_TOKENS)}),
    samp AS (SELECT "column", chunk_id, string_agg(value, '|' ORDER BY row_id) AS samples
             FROM vals WHERE rn <= {V.ERROR_SAMPLE_SIZE} GROUP BY "column", chunk_id)
    SELECT p."column", p.chunk_id, p.requested_type,
           'could not convert ' || CAST(p.n_override_fail AS VARCHAR) || ' value(s) to ' || p.requested_type AS error,
           s.samples
    FROM prof p JOIN last l ON p."column" = l."column" AND p.chunk_id = l.chunk_id
    JOIN samp s ON s."column" = p."column" AND s.chunk_id = p.chunk_id""")


@register("chunk_errors_merged")
def _chunk_errors_merged(spark, d):
    from colsense.operators.chunks import merge_chunk_errors
    raw = dirty_raw(spark, d)
    types = chunk_types(raw, "row_id", CHUNK_ROWS, overrides=_CHUNK_OV, cols=DIRTY_COLUMNS)
    merged = merge_chunk_errors(chunk_errors(raw, types, "row_id", CHUNK_ROWS))
    return merged.select("column", "chunk_id", "requested_type", "error",
                         F.array_join("sample_values", "|").alias("samples"))


register("concat_union",
         f"SELECT row_id, o_orderkey, {S.fdouble('price')} AS price_raw FROM ({DIRTY_SQL}) "
         f"UNION ALL SELECT row_id + (SELECT count(*) FROM orders), o_orderkey, NULL FROM ({DIRTY_SQL})")


@register("concat_union")
def _concat_union(spark, d):
    from colsense.operators.chunks import concat_union
    from colsense.functions.numeric import strict_double
    raw = dirty_raw(spark, d)
    n = load(spark, d, "orders").count()
    a = raw.select("row_id", "o_orderkey", strict_double("price").alias("price_raw"))
    b = raw.select((F.col("row_id") + F.lit(n)).alias("row_id"), "o_orderkey")
    return concat_union([a, b])


register("coerced_counts",
         "SELECT \"column\", inferred_type, CAST(CASE WHEN inferred_type IN ('Int64', 'float64', 'complex128') THEN n_non_null - n_numeric "
         "WHEN inferred_type = 'timedelta64[ns]' THEN n_non_null - n_duration "
         "WHEN inferred_type = 'datetime64[ns]' THEN n_non_null - n_datetime ELSE 0 END AS BIGINT) AS n_coerced "
         f"FROM ({S.decide_sql(DIRTY_PROFILE_SQL)})")


@register("coerced_counts")
def _coerced_counts(spark, d):
    """I4: the dirty orders converted into a table, and the values lost in that pass."""
    raw = dirty_orders(load(spark, d, "orders")).select(*DIRTY_COLUMNS)
    types = infer_types(raw).collect()
    types = spark.createDataFrame([(r["column"], r["inferred_type"]) for r in types], "column string, inferred_type string")
    data, seen = convert_counted(raw, types)
    data.write.parquet(scratch_path(spark, "coerced"))
    return coerced_counts(spark, types, seen)


# --------------------------------------------------------------- category dictionary (K1)

register("category_dictionary",
         "SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code "
         "FROM (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL)")(
    lambda spark, d: category_dictionary(load(spark, d, "orders"), "o_orderpriority"))

register("category_codes",
         "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IS NOT NULL THEN CAST(dense_rank() OVER "
         "(ORDER BY o_orderpriority NULLS LAST) - 1 AS BIGINT) END AS o_orderpriority_code FROM orders")(
    lambda spark, d: category_codes(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))

register("category_growth",
         "SELECT value, code, version FROM (SELECT value, 0 AS version, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code "
         "FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0)) "
         "UNION ALL SELECT value, code, version FROM (SELECT value, 1 AS version, CAST(row_number() OVER (ORDER BY value) - 1 + "
         "(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 2 = 0) AS BIGINT) AS code "
         "FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey IS NOT NULL "
         "AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IS NOT NULL)))")


@register("category_growth")
def _category_growth(spark, d):
    """K1: customer codes from orders with even keys, then all orders; codes of the first stay."""
    orders, table = load(spark, d, "orders"), scratch_path(spark, "category_growth")
    extend_dictionary(orders.where("o_orderkey % 2 = 0"), "o_custkey", table, 0)
    extend_dictionary(orders, "o_custkey", table, 1)
    return read_dictionary(spark, table).withColumn("version", F.col("version").cast("int"))


# --------------------------------------------------------------- CSV source

def _orders_text(spark, d):
    return raw_table(spark, d, "orders")


def _written(spark, d, name, header=True, encoding=None):
    path = scratch_path(spark, name)
    write_csv(_orders_text(spark, d).drop("row_id"), path, header=header, encoding=encoding)
    return path


_ORDERS_TEXT_SQL = text_sql("orders")
register("csv_roundtrip", _ORDERS_TEXT_SQL)(
    lambda spark, d: read_csv(spark, _written(spark, d, "csv_roundtrip")))

_HEADERLESS = ", ".join(f"{c} AS Column_{i + 1}" for i, c in enumerate(TABLE_COLUMNS["orders"]))
register("csv_headerless", f"SELECT row_id, {_HEADERLESS} FROM ({_ORDERS_TEXT_SQL})")(
    lambda spark, d: read_csv(spark, _written(spark, d, "csv_headerless", header=False), has_headers=False))

_RAGGED_SQL_COLS = ", ".join(
    (f"CASE WHEN CAST(o_orderkey AS BIGINT) % 11 = 5 THEN NULL ELSE {c} END AS Column_{i + 1}"
     if i == len(TABLE_COLUMNS["orders"]) - 1 else f"{c} AS Column_{i + 1}")
    for i, c in enumerate(TABLE_COLUMNS["orders"]))
register("csv_ragged",
         f"SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_id, * EXCLUDE (row_id) FROM "
         f"(SELECT row_id, {_RAGGED_SQL_COLS} FROM ({_ORDERS_TEXT_SQL}) WHERE CAST(o_orderkey AS BIGINT) % 7 <> 3)")


def _ragged_file(spark, d):
    """Lines with an extra field (key % 7 = 3) are dropped; lines missing the
    last field (key % 11 = 5) are padded with null."""
    t = _orders_text(spark, d)
    cols = [c for c in t.columns if c != "row_id"]
    key = F.col("o_orderkey").cast("long")
    line = (F.when(key % 7 == 3, F.concat_ws(",", *cols, F.lit("extra")))
            .when(key % 11 == 5, F.concat_ws(",", *cols[:-1]))
            .otherwise(F.concat_ws(",", *cols)))
    path = scratch_path(spark, "csv_ragged")
    t.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


register("csv_ragged")(lambda spark, d: read_csv(spark, _ragged_file(spark, d), has_headers=False))
register("csv_dropped_counts",
         f"SELECT count(*) AS n_rows, count(*) FILTER (CAST(o_orderkey AS BIGINT) % 7 = 3) AS n_dropped FROM ({_ORDERS_TEXT_SQL})")(
    lambda spark, d: dropped_rows(spark, _ragged_file(spark, d), has_headers=False)
    .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_dropped").alias("n_dropped")))


@register("csv_quotes", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def _csv_quotes(spark, d):
    """Whole document texts, with their quotes, commas and line breaks, written and read back."""
    path = scratch_path(spark, "csv_quotes")
    write_csv(load(spark, d, "documents").select(F.col("doc_id").cast("string"), "text", "source"), path)
    return read_csv(spark, path, row_id=None, multiline=True)


_LINES = "CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT)"
register("encoding_audit",
         f"SELECT 'utf8' AS written_as, 'utf-8' AS encoding, {_LINES} AS n_lines FROM documents "
         "UNION ALL SELECT 'latin1' AS written_as, "
         "CASE WHEN bool_or(regexp_matches(coalesce(text, ''), '[\\x{81}\\x{8d}\\x{8f}\\x{90}\\x{9d}]')) "
         f"THEN 'iso-8859-1' ELSE 'cp1252' END AS encoding, {_LINES} AS n_lines FROM documents")


@register("encoding_audit")
def _encoding_audit(spark, d):
    """Documents text written as UTF-8 and as Latin-1 files; one row per file."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    base = scratch_path(spark, "encoding_audit")
    docs.write.mode("overwrite").option("encoding", "UTF-8").csv(base + "/utf8")
    docs.write.mode("overwrite").option("encoding", "ISO-8859-1").csv(base + "/latin1")
    return audit_encodings(spark, base + "/*").select(
        F.regexp_extract("path", r"/(utf8|latin1)/", 1).alias("written_as"), "encoding", "n_lines")


_LATIN = "regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')"
register("csv_mixed_encodings",
         "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN text IS NULL OR text = '' THEN NULL "
         f"WHEN doc_id % 3 = 1 THEN {_LATIN} ELSE text END AS text FROM documents")


@register("csv_mixed_encodings")
def _csv_mixed_encodings(spark, d):
    """Documents dealt to UTF-8, Latin-1 and UTF-16 files, line breaks in quotes
    and all, and the folder read in one job by each file's own encoding."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    base = scratch_path(spark, "csv_mixed")
    for i, encoding in enumerate(("UTF-8", "ISO-8859-1", "UTF-16")):
        write_csv(docs.where(F.col("doc_id") % 3 == i), f"{base}/{i}", encoding=encoding)
    return read_csv(spark, base + "/*", encoding="auto", row_id=None)


_DRAWN = "(" + " UNION ALL ".join(
    f'SELECT row_id, {S.q(c)} AS "column", {i} AS position, {c} AS value FROM ({text_sql("events")})'
    for i, c in enumerate(TABLE_COLUMNS["events"])) + ")"
_SAMPLED = ("(SELECT *, NOT missing AND row_number() OVER (PARTITION BY \"column\", missing "
            f"ORDER BY md5(\"column\" || ':' || row_id)) <= 1000 AS drawn FROM {S.flags_cte(_DRAWN)})")
_SAMPLE_PROFILE = f"""
    SELECT "column", count(*) AS n_rows, CAST(count(*) FILTER (NOT missing) AS BIGINT) AS n_non_null,
      count(DISTINCT value) FILTER (NOT missing) AS n_distinct,
      bool_and(CASE WHEN NOT missing THEN boolish END) AS all_bool,
      CAST(count(*) FILTER (drawn) AS BIGINT) AS n_sampled,
      CAST(count(*) FILTER (drawn AND num_ok) AS BIGINT) AS n_numeric,
      COALESCE(bool_or(NOT missing AND num_ok AND cplx), FALSE) AS any_complex,
      COALESCE(bool_and(CASE WHEN NOT missing AND num_ok AND NOT cplx THEN integral END), TRUE) AS all_integral,
      CAST(count(*) FILTER (drawn AND dur_ok) AS BIGINT) AS n_duration,
      CAST(count(*) FILTER (drawn AND dt_ok) AS BIGINT) AS n_datetime, 0 AS n_override_fail
    FROM {_SAMPLED} GROUP BY "column\""""
_SAMPLE_COLS = ["column", "n_non_null", "n_sampled", "n_numeric", "n_duration", "n_datetime", "inferred_type"]


@register("sample_deterministic", 'SELECT "column", ' + ", ".join(_SAMPLE_COLS[1:]) + f" FROM ({S.decide_sql(_SAMPLE_PROFILE)})")
def _sample_deterministic(spark, d):
    """Parse ratios from a draw of exactly 1 000 present values per column of events."""
    raw = raw_table(spark, d, "events")
    return decide(profile(raw, [c for c in raw.columns if c != "row_id"], sample_rows=1000,
                          row_id="row_id")).select(*_SAMPLE_COLS)


# --------------------------------------------------------------- streaming

_STREAM_FILES = 8
_STREAM_CHUNKS = f"SELECT *, row_id % {_STREAM_FILES} AS chunk_id FROM ({text_sql('orders')})"


def _typed_stream(spark, d, **options):
    """Orders text written as eight CSV files, dealt by row id, and typed in eight micro-batches."""
    from colsense.streaming import start_typing_stream
    src, table = scratch_path(spark, "stream_source"), scratch_path(spark, "stream_types")
    rows = _orders_text(spark, d).withColumn("file", F.col("row_id") % _STREAM_FILES).drop("row_id")
    write_csv(rows.repartition(_STREAM_FILES, "file"), src, partition_by="file")
    # the folders by file number are no column of the stream
    start_typing_stream(spark, src + "/file=*", TABLE_COLUMNS["orders"], table, max_files_per_trigger=1, **options).awaitTermination()
    return table


register("stream_chunk_types",
         "SELECT \"column\", CASE WHEN count(DISTINCT inferred_type) = 1 THEN max(inferred_type) ELSE 'object' END AS inferred_type, "
         "CAST(count(*) AS BIGINT) AS n_chunks "
         f"FROM ({S.decide_sql(S.profile_sql(_STREAM_CHUNKS, TABLE_COLUMNS['orders'], group='chunk_id'))}) GROUP BY \"column\"")


@register("stream_chunk_types")
def _stream_chunk_types(spark, d):
    """One type where all micro-batches agree."""
    from colsense.streaming import merged_stream_types
    return merged_stream_types(spark, _typed_stream(spark, d)).select("column", "inferred_type", "n_chunks")


_STREAM_COLS = ["column", "position", "inferred_type", "n_rows", "n_missing", "n_non_null", "n_numeric", "n_duration", "n_datetime",
                "all_bool", "any_complex", "all_integral"]
register("stream_profile_types",
         f"SELECT {', '.join(('"column"' if c == 'column' else c) for c in _STREAM_COLS)} FROM ({S.decide_sql(_profile_sql('orders'))})")


@register("stream_profile_types")
def _stream_profile_types(spark, d):
    """Types from the merged profile of all micro-batches: those of one pass over all rows."""
    from colsense.streaming import stream_types
    return stream_types(spark, _typed_stream(spark, d)).select(*_STREAM_COLS)


# --------------------------------------------------------------- approximate profile (scale option)

register("infer_types_lineitem_approx",
         f"SELECT \"column\", inferred_type FROM ({S.decide_sql(_profile_sql('lineitem'))})")(
    lambda spark, d: infer_types(text_table(spark, d, "lineitem"), exact=False).select("column", "inferred_type"))
