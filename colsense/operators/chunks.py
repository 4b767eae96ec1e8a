"""Inference per chunk of rows, and the merge of chunk results.

A chunk is ``floor(row_id / chunk_rows)``; all chunks are profiled in the
same single grouped pass (the chunk id is one more grouping key), and each
chunk's categorical thresholds use the chunk's own row count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.functions import vocab as V
from colsense.operators.infer import decide
from colsense.operators.overrides import failure_text, raw_value
from colsense.operators.profile import profile
from colsense.sources.storage import checkpoint_dir


def with_chunk_id(df: DataFrame, row_id: str = "row_id",
                  chunk_rows: int = V.DEFAULT_CHUNK_ROWS) -> DataFrame:
    return df.withColumn("chunk_id", F.floor(F.col(row_id) / F.lit(chunk_rows)).cast("long"))


def chunk_types(df: DataFrame, row_id: str = "row_id", chunk_rows: int = V.DEFAULT_CHUNK_ROWS,
                overrides: Mapping[str, str] | None = None, cols: Sequence[str] | None = None,
                exact: bool = True) -> DataFrame:
    """(chunk_id, column, position, inferred_type, ...) - one row per chunk and column."""
    cols = [c for c in (cols or df.columns) if c not in (row_id, "chunk_id")]
    prof = profile(with_chunk_id(df, row_id, chunk_rows), cols, group_cols=["chunk_id"],
                   overrides=overrides, exact=exact)
    return decide(prof, overrides)


def merge_chunk_types(types: DataFrame) -> DataFrame:
    """One type where all chunks agree, otherwise object."""
    return types.groupBy("column").agg(
        F.min("position").alias("position"),
        F.when(F.count_distinct("inferred_type") == 1, F.max("inferred_type"))
         .otherwise(F.lit(V.OBJECT)).alias("inferred_type"),
        F.count(F.lit(1)).alias("n_chunks"))


def chunk_errors(df: DataFrame, types: DataFrame, row_id: str = "row_id",
                 chunk_rows: int = V.DEFAULT_CHUNK_ROWS,
                 k: int = V.ERROR_SAMPLE_SIZE) -> DataFrame:
    """Error rows per failing (chunk, column) with that chunk's first k values.

    The sample window is partitioned by (chunk, column): a group never holds
    more than ``chunk_rows`` rows, however large the table."""
    # failing (chunk, column) rows are read four times below; checkpoint them
    # once so the chunk profile is not recomputed (they are far fewer than the
    # data, but may be too many for the driver)
    checkpoint_dir(df.sparkSession)
    failed = types.where("override_failed").select("chunk_id", "column", "requested_type",
                                                   "n_override_fail").checkpoint(eager=True)
    cols = [r["column"] for r in failed.select("column").distinct().collect()]
    if not cols:
        return failed.select("chunk_id", "column", "requested_type",
                             F.lit(None).cast("string").alias("error"),
                             F.array().cast("array<string>").alias("sample_values")).limit(0)
    long = (with_chunk_id(df.select(row_id, *cols), row_id, chunk_rows)
            .unpivot([row_id, "chunk_id"], cols, "column", "value")
            .where(raw_value(F.col("value")).isNotNull())
            .join(failed.select("chunk_id", "column"), ["chunk_id", "column"], "left_semi"))
    w = Window.partitionBy("chunk_id", "column").orderBy(row_id)
    samples = (long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
               .groupBy("chunk_id", "column")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value"))),
                                lambda s: s["value"]).alias("sample_values")))
    types_seen = sorted({r["requested_type"] for r in failed.select("requested_type").distinct().collect()})
    text = F.coalesce(*[F.when(F.col("requested_type") == t, failure_text(t, F.col("n_override_fail")))
                        for t in types_seen])
    return (failed.join(samples, ["chunk_id", "column"], "left")
                  .select("chunk_id", "column", "requested_type", text.alias("error"),
                          F.coalesce("sample_values", F.array().cast("array<string>"))
                           .alias("sample_values")))


def merge_chunk_errors(errors: DataFrame) -> DataFrame:
    """Per column, the error of the latest failing chunk wins."""
    latest = F.max_by(F.struct("chunk_id", "requested_type", "error", "sample_values"), F.col("chunk_id"))
    return (errors.groupBy("column").agg(latest.alias("e"))
                  .select("column", "e.chunk_id", "e.requested_type", "e.error", "e.sample_values"))


def concat_union(frames: Sequence[DataFrame]) -> DataFrame:
    """C4: union of converted pieces by column name, missing columns as null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
