"""Typing of a folder that keeps receiving CSV files.

Each micro-batch is one chunk.  ``foreachBatch`` writes three tables, each
partitioned by ``batch_id`` with dynamic partition overwrite, so a batch replayed
after a failure replaces its own rows and nothing else:

* ``profile``: the batch's profile and types, with sketches (``mergeable``);
* ``errors``: the overrides that fail in the batch, with their first values;
* ``batches``: its rows, and the rows dropped because they have too many fields.

Two views follow.  ``merged_stream_types`` is the chunk merge (same type
everywhere, else object).  ``stream_types`` decides from the merged profile of
all rows so far, as if the files had been read at once.  No state store is
needed: these tables are the state, and they outlive the query.

Records follow the same rules as in ``read_csv``: one dialect, rows with too many
fields dropped and counted, rows with too few padded, headers compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.functions.text import named
from colsense.operators.chunks import merge_chunk_errors, merge_chunk_types
from colsense.operators.convert import ERRORS_SCHEMA, errors_frame
from colsense.operators.infer import decide
from colsense.operators.mergeable import add_to_profile, stored_profile
from colsense.sources.csv import CORRUPT, dialect, has_more_fields, with_file_order_id
from colsense.sources.storage import scratch_path

PROFILE, ERRORS, BATCHES = "profile", "errors", "batches"
_ERROR_ROWS = T.StructType([*ERRORS_SCHEMA.fields, T.StructField("batch_id", T.LongType())])
_BATCH_ROWS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_rows", "n_dropped", "batch_id")])


def _at(table_dir: str, name: str) -> str:
    return f"{table_dir.rstrip('/')}/{name}"


def _put(df: DataFrame, table_dir: str, name: str, batch_id: int) -> None:
    """Replace the rows of one batch; they are bounded by the schema: one file."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").partitionBy("batch_id")
       .option("partitionOverwriteMode", "dynamic").parquet(_at(table_dir, name)))


def _write_batch(table_dir: str, cols: Sequence[str], overrides: Mapping[str, str] | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        # counted on the way to the profile: no scan of its own
        rows = batch.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if("_long").alias("n_dropped"))
        add_to_profile(rows.where("NOT _long").select(*map(named, cols)), _at(table_dir, PROFILE), batch_id, cols, overrides)
        counted = seen.get
        types = spark.read.parquet(_at(table_dir, PROFILE)).where(F.col("batch_id") == batch_id)
        if overrides:
            numbered = with_file_order_id(batch.where("NOT _long"), "_row")
            _put(errors_frame(numbered.select("_row", *map(named, cols)), types, overrides, "_row"), table_dir, ERRORS, batch_id)
        _put(spark.createDataFrame([(counted["n_rows"], counted["n_dropped"])], "n_rows long, n_dropped long"),
             table_dir, BATCHES, batch_id)
    return write


def start_typing_stream(spark: SparkSession, source_dir: str, columns: Sequence[str],
                        table_dir: str, has_headers: bool = True,
                        overrides: Mapping[str, str] | None = None,
                        checkpoint: str | None = None, available_now: bool = True,
                        max_files_per_trigger: int | None = None, sep: str = ",",
                        encoding: str | None = None, multiline: bool = False):
    """Start the stream; returns the StreamingQuery.

    ``columns`` are the fields of every file, in order.  A file whose header has
    other names fails its batch, unless a name is blank or repeated (Spark's
    reader can't compare those).  ``multiline`` allows line breaks in quoted
    fields; a file is one task then."""
    columns = list(columns)
    comparable = has_headers and all(c.strip() for c in columns) and len({c.lower() for c in columns}) == len(columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    reader = (spark.readStream.schema(schema).options(**dialect(sep)).option("header", str(has_headers).lower())
              .option("enforceSchema", str(not comparable).lower()).option("multiLine", str(multiline).lower()))
    if encoding:
        reader = reader.option("encoding", encoding)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # all columns are read, so that Spark's parser flags the same rows as in read_csv
    reads_data = F.length(F.concat_ws("\u0001", *map(named, columns))) >= 0
    long = has_more_fields(F.col(CORRUPT), len(columns), sep) & reads_data
    text = (lambda c: F.regexp_replace(named(c), "�", "").alias(c)) if encoding else named
    stream = reader.csv(source_dir).select(*map(text, columns), F.coalesce(long, F.lit(False)).alias("_long"), "_metadata")
    writer = (stream.writeStream.foreachBatch(_write_batch(table_dir, columns, overrides))
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def batch_types(spark: SparkSession, table_dir: str) -> DataFrame:
    """Profile and types of each batch, one row per batch and column."""
    return spark.read.parquet(_at(table_dir, PROFILE)).drop("distinct_sketch")


def merged_stream_types(spark: SparkSession, table_dir: str) -> DataFrame:
    """C2 over every batch written so far."""
    return merge_chunk_types(batch_types(spark, table_dir).withColumnRenamed("batch_id", "chunk_id"))


def stream_types(spark: SparkSession, table_dir: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Types decided from all rows so far, with their profile."""
    return decide(stored_profile(spark, _at(table_dir, PROFILE)).drop("distinct_sketch"), overrides)


def _table(spark: SparkSession, table_dir: str, name: str, schema: T.StructType) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    # a table that no batch has written yet is empty
    empty.write.mode("ignore").partitionBy("batch_id").parquet(_at(table_dir, name))
    return spark.read.schema(schema).parquet(_at(table_dir, name))


def stream_errors(spark: SparkSession, table_dir: str) -> DataFrame:
    """The failing overrides of every batch."""
    return _table(spark, table_dir, ERRORS, _ERROR_ROWS)


def merged_stream_errors(spark: SparkSession, table_dir: str) -> DataFrame:
    """Per column, the error of the latest failing batch."""
    return merge_chunk_errors(stream_errors(spark, table_dir).withColumnRenamed("batch_id", "chunk_id"))


def stream_batches(spark: SparkSession, table_dir: str) -> DataFrame:
    """(n_rows, n_dropped, batch_id): records read and dropped by batch."""
    return _table(spark, table_dir, BATCHES, _BATCH_ROWS)
