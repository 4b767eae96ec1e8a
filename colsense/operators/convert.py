"""Convert raw text columns to their types; error rows.

``convert`` is one narrow ``select``: every column becomes one native Column
expression chosen from its type.  Types are looked up on the driver from the
types DataFrame, which has one row per column (bounded by the schema).
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.functions import vocab as V
from colsense.functions.boolean import to_bool
from colsense.functions.datetime import to_datetime
from colsense.functions.duration import to_duration
from colsense.functions.missing import is_missing, null_if_missing
from colsense.functions.numeric import numeric_parts, to_bigint, to_complex
from colsense.functions.text import frozen, memo_column, named
from colsense.operators.infer import infer_types
from colsense.operators.overrides import failure_text, override_value, raw_value
from colsense.operators.rowid import with_row_id

Result = namedtuple("Result", ["data", "types", "errors"])

ERRORS_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("requested_type", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


_PLAIN_INT = r"^[0-9]{1,18}$"
_PLAIN_DECIMAL = r"^[0-9]{1,300}(?:\.[0-9]+)?$"


def typed_value(c, type_name: str, numeric_options: Mapping | None = None) -> Column:
    """The inferred type's cleaner on the missing-normalised value."""
    v = null_if_missing(F.col(c) if isinstance(c, str) else c)
    if type_name == V.BOOL:
        return to_bool(v)
    if type_name in (V.INT, V.FLOAT, V.COMPLEX):
        parts = numeric_parts(v, **(numeric_options or {}))
        # plain digits (most rows of a numeric column) are cast directly; the
        # general cleaner gives the same value for them
        if type_name == V.INT:
            return F.when(v.rlike(_PLAIN_INT), v.cast("bigint")).otherwise(to_bigint(parts))
        if type_name == V.FLOAT:
            return F.when(v.rlike(_PLAIN_DECIMAL), v.cast("double")).otherwise(parts["value"])
        return to_complex(parts)
    if type_name == V.DURATION:
        return to_duration(v)
    if type_name == V.DATETIME:
        return to_datetime(v)
    return v


def _category_field(c: Column, name: str) -> Column:
    return c.alias(name, metadata={"logical_type": V.CATEGORY})


def column_expr(name: str, type_name: str, override_ok: bool = False,
                numeric_options: Mapping | None = None, source: str | None = None) -> Column:
    return memo_column(lambda: _column_expr(name, type_name, override_ok, numeric_options, source),
                       "convert", name, type_name, override_ok, frozen(numeric_options), source)


def _column_expr(name: str, type_name: str, override_ok: bool, numeric_options, source) -> Column:
    src = named(source or name).cast("string")
    if override_ok:
        out = override_value(src, type_name)
    else:
        out = typed_value(src, type_name, numeric_options)
    if type_name == V.CATEGORY:
        return _category_field(out, name)
    return out.alias(name)


def _type_rows(types) -> list[dict]:
    if isinstance(types, Mapping):
        return [{"column": k, "inferred_type": v, "override_ok": False} for k, v in types.items()]
    asked = [F.col(c) if c in types.columns else F.lit(None).alias(c) for c in ("requested_type", "override_failed")]
    rows = types.select("column", "inferred_type", *asked).collect()  # merged chunk types have no override columns
    return [{"column": r["column"], "inferred_type": r["inferred_type"],
             "override_ok": r["requested_type"] is not None and not r["override_failed"]}
            for r in rows]


def convert(df: DataFrame, types, keep: Sequence[str] = (),
            numeric_options: Mapping | None = None) -> DataFrame:
    """Typed DataFrame: ``keep`` columns pass through, typed columns follow
    in their original order, other columns pass through unchanged."""
    by_name = {r["column"]: r for r in _type_rows(types)}
    out = []
    for name in df.columns:
        r = by_name.get(name)
        if r is None or name in keep:
            out.append(named(name))
        else:
            out.append(column_expr(name, r["inferred_type"], r["override_ok"], numeric_options))
    return df.select(*out)


def convert_counted(df: DataFrame, types, keep: Sequence[str] = (),
                    numeric_options: Mapping | None = None) -> tuple[DataFrame, Observation]:
    """I4: ``convert`` with an observation of how many present values of each
    column became null, counted in the pass that reads the result: no second
    scan.  ``coerced_counts`` gives them after the first action on the result.
    Later actions don't count again."""
    rows = [r for r in _type_rows(types) if r["column"] in df.columns and r["column"] not in keep]
    typed = {r["column"]: column_expr(r["column"], r["inferred_type"], r["override_ok"], numeric_options) for r in rows}
    place = {r["column"]: i for i, r in enumerate(rows)}
    if not rows:
        return df, Observation("coerced")
    both = df.select(*(typed.get(c, named(c)) for c in df.columns),
                     *(named(c).cast("string").alias(f"__raw_{i}") for c, i in place.items()))
    seen = Observation("coerced")
    lost = [F.count_if(~is_missing(F.col(f"__raw_{i}")) & named(c).isNull()).alias(str(i)) for c, i in place.items()]
    return both.observe(seen, *lost).select(*map(named, df.columns)), seen


def coerced_counts(spark: SparkSession, types, seen: Observation, keep: Sequence[str] = ()) -> DataFrame:
    """(column, inferred_type, n_coerced): one row per column of ``types``."""
    counts = seen.get
    rows = [r for r in _type_rows(types) if r["column"] not in keep]
    return spark.createDataFrame([(r["column"], r["inferred_type"], counts[str(i)]) for i, r in enumerate(rows)],
                                 "column string, inferred_type string, n_coerced long")


def error_samples(df: DataFrame, columns: Sequence[str], row_id: str,
                  k: int = V.ERROR_SAMPLE_SIZE) -> DataFrame:
    """First k non-null raw values of each column in row order.

    One pass over the failing columns: every task keeps its first k values of
    each column before the shuffle, so a column's window sees k rows a task."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, sample_values array<string>")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), raw_value(named(c).cast("string")).alias("_v"))
                                 for c in columns)))
    long = df.select(named(row_id).alias("_rid"), values.alias("_x")).select("_rid", "_x.*").where("_v is not null")
    first = F.row_number().over(Window.partitionBy("column").orderBy("_rid"))
    return long.withColumn("_n", first).where(F.col("_n") <= k).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rid", "_v"))),
                    lambda s: s["_v"]).alias("sample_values"))


def errors_frame(df: DataFrame, types: DataFrame, overrides: Mapping[str, str] | None,
                 row_id: str | None) -> DataFrame:
    """One row per failed override (column, requested_type, error, samples)."""
    spark = df.sparkSession
    failed = [(r["column"], r["requested_type"], r["n_override_fail"])
              for r in types.where("override_failed")
                            .select("column", "requested_type", "n_override_fail").collect()]
    if not failed:
        return spark.createDataFrame([], ERRORS_SCHEMA)
    if row_id is None:
        df, row_id = with_row_id(df, name="_row_id"), "_row_id"
    samples = error_samples(df, [c for c, _, _ in failed], row_id)
    rows = spark.createDataFrame([(c, t, n) for c, t, n in failed],
                                 "column string, requested_type string, n_failed long")
    texts = F.coalesce(*[F.when(F.col("requested_type") == t, failure_text(t, F.col("n_failed")))
                         for t in sorted({t for _, t, _ in failed})])
    return (rows.join(samples, "column", "left")
                .select("column", "requested_type", texts.alias("error"),
                        F.coalesce("sample_values", F.array().cast("array<string>"))
                         .alias("sample_values")))


def infer_and_convert(df: DataFrame, overrides: Mapping[str, str] | None = None,
                      row_id: str | None = None, cols: Sequence[str] | None = None,
                      exact: bool = True, sample_rows: int | None = None,
                      numeric_options: Mapping | None = None) -> Result:
    """(typed data, types, errors).  The types are computed once and
    cached as a tiny table, so the data and error views reuse them."""
    types = infer_types(df, overrides=overrides, cols=cols, row_id=row_id, exact=exact,
                        sample_rows=sample_rows, numeric_options=numeric_options)
    types = types.sparkSession.createDataFrame(types.collect(), types.schema)
    keep = [row_id] if row_id else []
    data = convert(df, types, keep=keep, numeric_options=numeric_options)
    errors = errors_frame(df, types, overrides, row_id)
    return Result(data, types, errors)


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """K1: distinct non-missing values with a dense code in value order.

    Codes come from a range-partitioned sort (no single-partition window),
    so the dictionary may be as large as the data allows."""
    v = null_if_missing(F.col(column).cast("string"))
    distinct = df.select(v.alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_row_id(distinct, order_by=["value"], name="code")


def category_codes(df: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_code`` by joining the dictionary back.  Spark broadcasts
    the dictionary if its measured size in bytes allows it, else it joins by
    exchange, where adaptive execution splits a value that many rows have.
    Missing values have no code."""
    d = dictionary if dictionary is not None else category_dictionary(df, column)
    d = d.withColumnRenamed("value", "_cat_value").withColumnRenamed("code", f"{column}_code")
    key = null_if_missing(F.col("`" + column.replace("`", "``") + "`").cast("string"))
    return df.withColumn("_cat_value", key).join(d, "_cat_value", "left").drop("_cat_value")
