"""The column profile, one grouped pass over the whole table.

Layout (long): unpivot the wanted columns to (column, value), count each
distinct (column, value) pair - map-side partial aggregation absorbs hot
values - then aggregate the per-value flags per column, weighted by the
counts.  The cleaners therefore run once per distinct value, not per row.
Values longer than ``LONG_VALUE`` characters have their flags computed per
row and are grouped by a SHA-256 digest instead of their text, so free-text
columns do not shuffle whole documents.

With ``exact=False`` the distinct count is approximate and there is no
grouping by value at all: flags are computed per row and only partial
aggregates are shuffled (one row per column per partition).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.functions.boolean import is_bool_token
from colsense.functions.datetime import to_datetime
from colsense.functions.duration import DAY_LETTERS, duration_days
from colsense.functions.missing import is_missing
from colsense.functions.numeric import is_integral, numeric_parts
from colsense.functions.text import frozen, let, memo_column, named
from colsense.operators.overrides import override_fails

LONG_VALUE = 128
SKETCH_LG = 14

PROFILE_FIELDS = ["n_rows", "n_missing", "n_non_null", "n_distinct", "all_bool", "n_sampled",
                  "n_numeric", "any_complex", "all_integral", "n_duration", "n_datetime",
                  "n_override_fail"]


def _position_of(cols: Sequence[str]) -> Column:
    m = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return F.element_at(m, F.col("column"))


def _override_of(overrides: Mapping[str, str], v: Column) -> Column:
    """Per-value override failure, dispatched on the column name."""
    expr = F.lit(False)
    for name, type_name in overrides.items():
        expr = F.when(F.col("column") == name, override_fails(v, type_name)).otherwise(expr)
    return expr


# Plain unsigned decimals are most values of numeric columns; their flags
# follow directly: never missing, boolean only as 0/1, always a day count, a
# date only as 8 digits (yyyyMMdd).
_PLAIN_DECIMAL = r"^[0-9]+(?:\.[0-9]+)?$"
# ISO-style dates / date-times (most values of timestamp columns): no number,
# boolean, missing spelling or day count can have this shape, so only the
# date parse is left to run.
_ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?$"
# Letters alone (codes, flags, single words): no date, and no number but the
# imaginary unit; a count of days only by name.
_LETTERS = r"^[A-Za-z]+\z"


def value_flags(v: Column, overrides: Mapping[str, str] | None = None,
                numeric_options: Mapping | None = None) -> Column:
    """All per-value facts the decision needs, as one struct."""
    ovr = _override_of(overrides or {}, v)

    def general(num, missing):
        return F.struct(
            missing.alias("missing"),
            is_bool_token(v).alias("boolish"),
            num["ok"].alias("num_ok"),
            num["cplx"].alias("cplx"),
            F.coalesce(is_integral(num["value"]), F.lit(False)).alias("integral"),
            duration_days(v).isNotNull().alias("dur_ok"),
            F.when(~missing, to_datetime(v).isNotNull()).alias("dt_ok"),
            ovr.alias("ovr_fail"),
        )

    d = v.cast("double")
    plain = F.struct(
        F.lit(False).alias("missing"),
        v.isin("0", "1").alias("boolish"),
        F.lit(True).alias("num_ok"),
        F.lit(False).alias("cplx"),
        is_integral(d).alias("integral"),
        F.lit(True).alias("dur_ok"),
        F.when(v.rlike("^[0-9]{8}$"), to_datetime(v).isNotNull()).otherwise(F.lit(False)).alias("dt_ok"),
        ovr.alias("ovr_fail"),
    )
    iso = F.struct(
        F.lit(False).alias("missing"),
        F.lit(False).alias("boolish"),
        F.lit(False).alias("num_ok"),
        F.lit(False).alias("cplx"),
        F.lit(False).alias("integral"),
        F.lit(False).alias("dur_ok"),
        to_datetime(v).isNotNull().alias("dt_ok"),
        ovr.alias("ovr_fail"),
    )
    low, missing = F.lower(v), is_missing(v)
    unit = low.isin("i", "j")
    letters = F.struct(
        missing.alias("missing"),
        is_bool_token(v).alias("boolish"),
        unit.alias("num_ok"),
        unit.alias("cplx"),
        F.lit(False).alias("integral"),
        low.isin(DAY_LETTERS).alias("dur_ok"),
        F.when(~missing, F.lit(False)).alias("dt_ok"),
        ovr.alias("ovr_fail"),
    )
    fast = v.rlike(_PLAIN_DECIMAL) & (F.length(v) <= 300)
    return (F.when(fast, plain).when(v.rlike(_ISO_DATE), iso).when(v.rlike(_LETTERS), letters)
            .otherwise(let(is_missing(v), lambda missing: let(
                numeric_parts(v, **(numeric_options or {})), lambda num: general(num, missing)))))


def _flags_of(name: str, overrides, numeric_options) -> Column:
    return memo_column(lambda: value_flags(F.col(name), overrides, numeric_options),
                       "flags", name, frozen(overrides), frozen(numeric_options))


def long_values(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., column, value) with every wanted column as text."""
    narrow = df.select(*group_cols, *[named(c).cast("string").alias(c) for c in cols])
    return _long(narrow, list(group_cols), cols)


def _long(narrow: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(ids..., column, value): one row per cell.  Names may hold dots."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), named(c).alias("value")) for c in cols))
    return narrow.select(*map(named, ids), F.explode(cells).alias("_cell")).select(*map(named, ids), "_cell.*")


def _aggregates(f: Column, w: Column, ws: Column) -> list[Column]:
    """Per-column aggregates of per-value flags ``f`` weighted by ``w``; the
    parse ratios use ``ws`` (the sampled weight, equal to ``w`` unsampled)."""
    present = ~f["missing"]
    return [
        F.sum(w).alias("n_rows"),
        F.sum(F.when(f["missing"], w).otherwise(0)).alias("n_missing"),
        F.bool_and(F.when(present, f["boolish"])).alias("all_bool"),
        F.sum(F.when(present, ws).otherwise(0)).alias("n_sampled"),
        F.sum(F.when(present & f["num_ok"], ws).otherwise(0)).alias("n_numeric"),
        F.coalesce(F.bool_or(present & f["num_ok"] & f["cplx"]), F.lit(False)).alias("any_complex"),
        F.coalesce(F.bool_and(F.when(present & f["num_ok"] & ~f["cplx"], f["integral"])),
                   F.lit(True)).alias("all_integral"),
        F.sum(F.when(present & f["dur_ok"], ws).otherwise(0)).alias("n_duration"),
        F.sum(F.when(present & f["dt_ok"], ws).otherwise(0)).alias("n_datetime"),
        F.sum(F.when(f["ovr_fail"], w).otherwise(0)).alias("n_override_fail"),
    ]


def sample_key(row_id: Column) -> Column:
    """The place of a (row, column) pair in its column's draw: an MD5, so the
    draw depends on neither the order nor the dealing of rows."""
    return F.md5(F.concat_ws(":", F.col("column"), row_id.cast("string")).cast("binary"))


def sample_limits(cells: DataFrame, row_id: str, sample_rows: int) -> dict[str, str]:
    """The largest key of each column's ``sample_rows`` smallest among its
    present values; columns that have no more than that are left out.

    Only cells whose key starts below a share of the key space are ranked, eight
    standard deviations more than wanted, so a column's window holds little over
    ``sample_rows`` cells however many rows there are; if a column still falls
    short, the share is doubled.  Comes to the driver: one row for each column.
    """
    present = cells.where(~is_missing(F.col("value")))
    counts = {r["column"]: r["n"] for r in present.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = (sample_rows + 8 * math.sqrt(sample_rows) + 64)
    share = {c: wide / n for c, n in counts.items() if n > sample_rows}
    limits = {}
    while share:
        of_column = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("column"))
        head = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
        keyed = present.where(F.col("column").isin(list(share))).select("column", sample_key(F.col(row_id)).alias("_key"))
        place = F.row_number().over(Window.partitionBy("column").orderBy("_key"))
        first = keyed.where(head < of_column).withColumn("_n", place).where(F.col("_n") <= sample_rows)
        found = first.groupBy("column").agg(F.max("_key").alias("last"), F.count(F.lit(1)).alias("n")).collect()
        limits |= {r["column"]: r["last"] for r in found if r["n"] == sample_rows}
        share = {c: 2 * x for c, x in share.items() if c not in limits}
    return limits


def sample_weight(row_id: Column, limits: Mapping[str, str]) -> Column:
    """1 when the (row, column) pair falls in the column's sample, else 0."""
    if not limits:
        return F.lit(1)
    last = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("column"))
    return F.when(last.isNull() | (sample_key(row_id) <= last), 1).otherwise(0)


def profile(df: DataFrame, cols: Sequence[str] | None = None, group_cols: Sequence[str] = (),
            overrides: Mapping[str, str] | None = None, exact: bool = True,
            numeric_options: Mapping | None = None, sample_rows: int | None = None,
            row_id: str | None = None, sketch: bool = False) -> DataFrame:
    """One row per (group..., column): counts and flags for the type decision.

    ``sketch`` adds ``distinct_sketch``, from which profiles of several tables
    get a common distinct count (``mergeable``).

    ``sample_rows`` (needs ``row_id``, without repeats) restricts the parse
    ratios to exactly that many present values per column, drawn by hash, or to
    all if there are fewer; ``n_sampled`` tells.  The default is a full pass."""
    gcols = list(group_cols)
    skip = set(gcols) | ({row_id} if row_id else set())
    cols = [c for c in (cols or df.columns) if c not in skip]
    overrides = {k: v for k, v in (overrides or {}).items() if k in cols}
    keep_id = [row_id] if (sample_rows and row_id) else []
    narrow = df.select(*gcols, *keep_id, *[named(c).cast("string").alias(c) for c in cols])
    lv = _long(narrow, gcols + keep_id, cols)
    if sample_rows:
        if not row_id:
            raise ValueError("sample_rows needs a row_id column")
        w_s = sample_weight(F.col(row_id), sample_limits(lv, row_id, sample_rows))
    else:
        w_s = F.lit(1)
    v = F.col("value")

    def sketches(name):
        present = F.when(~F.col("f.missing"), F.col(name))
        return [F.hll_sketch_agg(present, F.lit(SKETCH_LG)).alias("distinct_sketch")] if sketch else []

    if not exact:
        # flags once per row in their own projection.  Equal flags are counted
        # first: rows then cost one counter and one sketch, not every aggregate,
        # and the distinct counts add up, as equal values have equal flags
        flagged = lv.select(*gcols, "column", "value", w_s.alias("_ws"),
                            _flags_of("value", overrides, numeric_options).alias("f"))
        distinct = F.approx_count_distinct(F.when(~F.col("f.missing"), F.col("value")), 0.01).alias("distinct")
        alike = flagged.groupBy(*gcols, "column", "f").agg(
            F.count(F.lit(1)).alias("cnt"), F.sum("_ws").alias("cnt_s"), distinct, *sketches("value"))
        out = alike.groupBy(*gcols, "column").agg(
            *_aggregates(F.col("f"), F.col("cnt"), F.col("cnt_s")), F.sum("distinct").alias("n_distinct"),
            *([F.hll_union_agg("distinct_sketch").alias("distinct_sketch")] if sketch else []))
    else:
        is_long = F.coalesce(F.length(v) > LONG_VALUE, F.lit(False))
        key = F.when(is_long, F.sha2(v, 256)).otherwise(v)
        # long values carry their flags (computed per row) as part of the
        # grouping key; short values are flagged once per distinct value below
        long_flags = F.when(is_long, _flags_of("value", overrides, numeric_options))
        counts = [F.count(F.lit(1)).alias("cnt")]
        if sample_rows:
            counts.append(F.sum("_ws").cast("long").alias("cnt_s"))
        per_value = (lv.select(*gcols, "column", key.alias("key"), long_flags.alias("lf"),
                               w_s.alias("_ws"))
                       .groupBy(*gcols, "column", "key", "lf").agg(*counts))
        if not sample_rows:
            per_value = per_value.withColumn("cnt_s", F.col("cnt"))
        f = F.coalesce(F.col("lf"), _flags_of("key", overrides, numeric_options))
        flagged = per_value.select(*gcols, "column", "cnt", "cnt_s", f.alias("f"), *(["key"] if sketch else []))
        out = flagged.groupBy(*gcols, "column").agg(
            *_aggregates(F.col("f"), F.col("cnt"), F.col("cnt_s")),
            F.sum(F.when(~F.col("f.missing"), 1).otherwise(0)).alias("n_distinct"), *sketches("key"))

    return out.select(
        *gcols, "column", _position_of(cols).alias("position"),
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_missing").cast("long").alias("n_missing"),
        (F.col("n_rows") - F.col("n_missing")).cast("long").alias("n_non_null"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        "all_bool",
        F.col("n_sampled").cast("long").alias("n_sampled"),
        F.col("n_numeric").cast("long").alias("n_numeric"),
        "any_complex", "all_integral",
        F.col("n_duration").cast("long").alias("n_duration"),
        F.col("n_datetime").cast("long").alias("n_datetime"),
        F.col("n_override_fail").cast("long").alias("n_override_fail"),
        *(["distinct_sketch"] if sketch else []),
    )
