"""L3: contiguous row ids (0, 1, 2, ...) without a single-partition window.

With ``order_by`` the rows are range-partitioned and sorted on the key, and
that sorted result is checkpointed to the shared checkpoint folder: range
bounds are sampled, and two evaluations of the same range shuffle may draw
different bounds, so the row counts and the numbering must read one fixed
copy.  The checkpoint also cuts lineage, so a lost executor cannot change the
ids.  Each partition is numbered locally (monotonically_increasing_id keeps
partition order) and shifted by the row count of the partitions before it.
Without a key the current partition order is used - for a file scan that is
split order, which is deterministic.

The offsets table has one row per partition; Spark broadcasts it if it is
small.  A partition that the counts don't know raises, so rows are never lost
if a keyless input is dealt differently the second time.  Keys should be unique: rows that tie on the key may swap ids between runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.sources.storage import checkpoint_dir


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "row_id",
                num_partitions: int | None = None) -> DataFrame:
    cols = df.columns
    if order_by:
        # AQE may coalesce the range partitions: the checkpoint fixes whatever
        # layout it chose before anything is counted
        checkpoint_dir(df.sparkSession)
        ranged = (df.repartitionByRange(num_partitions, *order_by) if num_partitions
                  else df.repartitionByRange(*order_by))
        df = ranged.sortWithinPartitions(*order_by).checkpoint(eager=True)
    tagged = (df.withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    start = F.coalesce(F.col("_off"), F.raise_error(F.lit("the partitions changed while rows were numbered")))
    return (tagged.join(offsets, "_pid", "left")
                  .select(*cols, (start + local).alias(name)))
