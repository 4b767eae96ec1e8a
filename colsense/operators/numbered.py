"""L1/L3 on a stored table: rows numbered once, pages read from their files.

``write_numbered`` sorts a table over all tasks and writes it as it comes out of
the sort, each row with its partition and its place there, so it is written once
and there is no other copy.  A manifest, written last, has one row a file: its
partition and its first and last row id.  A page takes its files from the
manifest and reads nothing else.

Rows that tie on the key are ordered by all other columns, so ids are the same in
every run; only rows that are equal in all columns can't be told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.functions import vocab as V
from colsense.functions.text import named

_PART, _PLACE = "__part", "__place"


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def write_numbered(df: DataFrame, path: str, order_by: Sequence[str], rows_per_file: int = 1_000_000,
                   num_partitions: int | None = None) -> None:
    """``df`` as a numbered table at ``path``, ids 0, 1, ... by ``order_by`` (nulls
    first), in files of at most ``rows_per_file`` rows.  All columns must have an
    order (maps have none)."""
    spark = df.sparkSession
    keys = [*map(named, order_by), *(named(c) for c in df.columns if c not in order_by), F.col("__dealt")]
    # equal rows, however many, fall into as many partitions as others
    dealt = df.withColumn("__dealt", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(num_partitions, *keys) if num_partitions else dealt.repartitionByRange(*keys)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    (ranged.sortWithinPartitions(*keys).drop("__dealt").withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, place)
     .write.option("maxRecordsPerFile", rows_per_file).parquet(_data(path)))
    files = (spark.read.parquet(_data(path)).groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.min(_PART).alias("part"), F.min(_PLACE).alias("low"), F.max(_PLACE).alias("high")))
    sizes = files.groupBy("part").agg((F.max("high") + 1).alias("rows"))  # a row a partition
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    (files.join(offsets, "part").select("file", "part", "offset", (F.col("offset") + F.col("low")).alias("first"),
                                        (F.col("offset") + F.col("high")).alias("last"))
     .coalesce(1).write.parquet(_manifest(path)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, offset, first, last): the row ids of each file."""
    return spark.read.parquet(_manifest(path))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the manifest."""
    return manifest(spark, path).agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("n")).first()["n"]


def read_numbered(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """The whole table with its row ids, in no order."""
    offsets = manifest(spark, path).select(F.col("part").alias("__p"), F.col("offset").alias("__offset")).distinct()
    rows = spark.read.parquet(_data(path))
    return rows.join(offsets, F.col(_PART) == F.col("__p")).select(
        (F.col("__offset") + F.col(_PLACE)).alias(name), *(named(c) for c in rows.columns if c not in (_PART, _PLACE)))


def read_page(spark: SparkSession, path: str, page_no: int = 1, page_size: int = V.DEFAULT_PAGE_SIZE,
              name: str = "row_id") -> DataFrame:
    """L1: rows [(page-1)*size, page*size) in order.  Only the files that hold them are
    read, and of these only the row groups; the driver gets one row for each."""
    if page_no < 1:
        raise ValueError("page numbers start at 1")
    if page_size < 1:
        raise ValueError("page size must be positive")
    low = (page_no - 1) * page_size
    files = manifest(spark, path).where((F.col("last") >= low) & (F.col("first") < low + page_size)).collect()
    if not files:
        rows = spark.read.parquet(_data(path))
        return rows.select(F.lit(0).cast("long").alias(name), *(named(c) for c in rows.columns if c not in (_PART, _PLACE))).limit(0)
    rows = spark.read.parquet(*sorted(f["file"] for f in files))
    offsets = {f["part"]: f["offset"] for f in files}
    wanted = F.lit(False)
    row_id = F.lit(None).cast("long")
    for part, offset in sorted(offsets.items()):
        here = F.col(_PART) == part
        wanted |= here & (F.col(_PLACE) >= low - offset) & (F.col(_PLACE) < low + page_size - offset)
        row_id = F.when(here, F.col(_PLACE) + offset).otherwise(row_id)
    return rows.where(wanted).select(row_id.alias(name), *(named(c) for c in rows.columns if c not in (_PART, _PLACE))).orderBy(name)
