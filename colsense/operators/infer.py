"""The per-column decision cascade over a profile, as a Column when-chain.

override given and every value converts -> the requested type
all values missing                       -> object
every distinct value a boolean spelling  -> bool
>= 80 % numeric                          -> complex128 | Int64 | float64
few distinct values                      -> category
> 90 % day counts                        -> timedelta64[ns]
> 90 % date/time text                    -> datetime64[ns]
otherwise                                -> object
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.functions import vocab as V
from colsense.functions.labels import type_label
from colsense.operators.overrides import is_supported
from colsense.operators.profile import profile


def category_limits(n_rows: Column) -> tuple[Column, Column]:
    """(max distinct ratio, max distinct count) for a column of n_rows."""
    ratio = count = None
    for bound, r, c in V.CATEGORY_THRESHOLDS:
        ratio = F.when(n_rows <= bound, F.lit(r)) if ratio is None else ratio.when(n_rows <= bound, F.lit(r))
        count = F.when(n_rows <= bound, F.lit(c)) if count is None else count.when(n_rows <= bound, F.lit(c))
    return ratio.otherwise(F.lit(V.CATEGORY_TAIL[0])), count.otherwise(F.lit(V.CATEGORY_TAIL[1]))


def _requested(overrides: Mapping[str, str]) -> Column:
    if not overrides:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return F.element_at(m, F.col("column"))


def decide(prof: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``requested_type``, ``override_failed`` and ``inferred_type``."""
    overrides = dict(overrides or {})
    supported = {k: v for k, v in overrides.items() if is_supported(v)}
    req = _requested(overrides)
    req_ok = _requested(supported).isNotNull() & (F.col("n_override_fail") == 0)
    max_ratio, max_count = category_limits(F.col("n_rows"))
    sampled = F.col("n_sampled")
    numeric = (F.when(F.col("any_complex"), F.lit(V.COMPLEX))
               .when(F.col("all_integral"), F.lit(V.INT))
               .otherwise(F.lit(V.FLOAT)))
    cascade = (F.when(F.col("n_non_null") == 0, F.lit(V.OBJECT))
               .when(F.col("all_bool"), F.lit(V.BOOL))
               .when(F.try_divide(F.col("n_numeric"), sampled) >= V.NUMERIC_MIN_RATIO, numeric)
               .when((F.try_divide(F.col("n_distinct"), F.col("n_rows")) <= max_ratio)
                     | (F.col("n_distinct") <= max_count), F.lit(V.CATEGORY))
               .when(F.try_divide(F.col("n_duration"), sampled) > V.DURATION_MIN_RATIO, F.lit(V.DURATION))
               .when(F.try_divide(F.col("n_datetime"), sampled) > V.DATETIME_MIN_RATIO, F.lit(V.DATETIME))
               .otherwise(F.lit(V.OBJECT)))
    return (prof
            .withColumn("requested_type", req)
            .withColumn("override_failed", req.isNotNull() & ~req_ok)
            .withColumn("inferred_type", F.when(req_ok, req).otherwise(cascade)))


def infer_types(df: DataFrame, overrides: Mapping[str, str] | None = None,
                cols: Sequence[str] | None = None, row_id: str | None = None,
                exact: bool = True, sample_rows: int | None = None,
                numeric_options: Mapping | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per column: position, inferred type, display label and the profile."""
    skip = set(group_cols) | ({row_id} if row_id else set())
    cols = [c for c in (cols or df.columns) if c not in skip]
    prof = profile(df, cols, group_cols=group_cols, overrides=overrides, exact=exact,
                   numeric_options=numeric_options, sample_rows=sample_rows, row_id=row_id)
    out = decide(prof, overrides)
    return out.withColumn("label", type_label(F.col("inferred_type")))


def types_dict(types: DataFrame) -> dict[str, str]:
    """Collect a types DataFrame (one row per column - bounded by the schema)."""
    return {r["column"]: r["inferred_type"] for r in types.select("column", "inferred_type").collect()}
