"""A1-A10 over data that keeps growing: profiles that merge.

A part is the profile of some rows with a sketch of each column's distinct
values.  Parts are rows of a table partitioned by ``batch_id``; adding a batch
reads that batch only, and adding it again replaces it.  Counts and flags of the
merged profile are exact.  The distinct count is exact for one part, else that of
the united sketches (HyperLogLog of 2^14 registers, 0.8 % standard error, nearly
exact up to some hundreds), kept between the largest part's and the sum of all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.operators.infer import decide
from colsense.operators.profile import profile


def merge_profiles(parts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One profile, as of ``profile``, of parts with a ``distinct_sketch``; their
    sketches are united in the new one, which merges again."""
    united = F.hll_union_agg("distinct_sketch")
    distinct = F.least(F.sum("n_distinct"), F.greatest(F.max("n_distinct"), F.hll_sketch_estimate(united)))
    counts = ["n_rows", "n_missing", "n_non_null"]
    ratios = ["n_sampled", "n_numeric"]
    late = ["n_duration", "n_datetime", "n_override_fail"]
    return parts.groupBy(*group_cols, "column").agg(
        F.min("position").alias("position"), *(F.sum(c).alias(c) for c in counts),
        F.when(F.count(F.lit(1)) == 1, F.max("n_distinct")).otherwise(distinct).alias("n_distinct"),
        F.bool_and("all_bool").alias("all_bool"), *(F.sum(c).alias(c) for c in ratios),
        F.bool_or("any_complex").alias("any_complex"), F.bool_and("all_integral").alias("all_integral"),
        *(F.sum(c).alias(c) for c in late), united.alias("distinct_sketch"))


def add_to_profile(df: DataFrame, table_dir: str, batch_id: int, cols: Sequence[str] | None = None,
                   overrides: Mapping[str, str] | None = None) -> None:
    """Profile ``df`` into the part ``batch_id`` of the table, in place of one that is there."""
    part = decide(profile(df, cols, overrides=overrides, sketch=True), overrides)
    # a row for each column: one file (size bound: the schema)
    (part.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite")
         .partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(table_dir))


def stored_profile(spark: SparkSession, table_dir: str) -> DataFrame:
    """The profile of all rows added so far."""
    return merge_profiles(spark.read.parquet(table_dir))
