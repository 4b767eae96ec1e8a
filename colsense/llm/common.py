"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.sources.storage import scratch_path

#: ASCII white space: what separates words in every operator here.
SPACES = b" \t\n\x0b\x0c\r"

_SHIPPED: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.  Tables that
    hold whole texts may name a ``codec`` that packs them closer.

    This cuts the lineage with files that every executor can read, so a lost
    executor costs the tasks of one stage, and values that depend on how rows
    were dealt (such as row numbers) stay the same for every later reader.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` as a written table with ``index`` (0, 1, ... in each group, by
    ``order``, nulls first) and ``total`` (rows of the group).  Rows that tie
    on all of it are numbered as they were dealt.

    The sort is a range partitioning by all keys, so a group that holds most
    rows, or rows that are all equal, go to as many tasks as any others.  The
    counts that make the numbers are one row for each group and partition; a
    window meets at most one row of a group for each partition.
    """
    keys = [*groups, *order, "__dealt"]
    dealt = df.withColumn("__dealt", F.monotonically_increasing_id())
    placed = written(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__dealt")
                     .withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), label)
    runs = placed.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*groups)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__g_{g}") for g in groups),
                       (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("total"))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return placed.join(runs, same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias("index"), "total")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="colsense-package-"), "colsense_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target


_owner = None


def own_worker(module: str) -> None:
    """Python workers outlive a stage, and what an operator keeps in them stays.
    When another operator's task starts in a worker, the others forget theirs
    (``forget`` of their modules) and the memory goes back to the system."""
    global _owner
    if _owner == module:
        return
    if _owner is not None:
        for name, other in list(sys.modules.items()):
            if name.startswith(__package__ + ".") and name != module and hasattr(other, "forget"):
                other.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _owner = module


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str,
                piece_rows: int = 512) -> DataFrame:
    """``df.mapInArrow`` where ``fn`` takes at most ``piece_rows`` rows at a
    time and gives dictionaries of columns.  Small pieces bound the memory
    of a Python worker whatever the batch size of the session is."""
    ship(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker(module)
        for batch in batches:
            for at in range(0, batch.num_rows, piece_rows):
                for columns in fn(batch.slice(at, piece_rows)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(texts: list[bytes | str | None], limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of ``texts`` of at most ``limit`` bytes or code points, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit and i > start:
            yield start, i
            start, size = i, len(t or "")
    if start < len(texts):
        yield start, len(texts)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))
