"""K1 over data that keeps growing: category codes that never change.

A dictionary is a table (value, code) partitioned by ``version``.  A new version
adds only the values that the versions before it don't have, in value order and
with the codes that follow theirs, so old codes stay.  Adding a version again
replaces it, as long as no later one builds on it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.functions.missing import null_if_missing
from colsense.functions.text import named
from colsense.operators.rowid import with_row_id

SCHEMA = "value string, code long, version long"


def read_dictionary(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame:
    """(value, code, version), of all versions or of those ``before`` one; empty
    if the table is not there yet."""
    try:
        table = spark.read.schema(SCHEMA).parquet(table_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    return table if before is None else table.where(F.col("version") < before)


def extend_dictionary(df: DataFrame, column: str, table_dir: str, version: int) -> None:
    """Add the values of ``column`` that no earlier version has.  Missing values
    get no code; a version without new values adds nothing."""
    spark = df.sparkSession
    stored = read_dictionary(spark, table_dir).agg(
        F.max("version").alias("version"), F.max(F.when(F.col("version") < version, F.col("code"))).alias("code")).first()
    if stored["version"] is not None and stored["version"] > version:
        raise ValueError(f"version {stored['version']} builds on version {version}: it can't be written again")
    first = 0 if stored["code"] is None else stored["code"] + 1
    values = df.select(null_if_missing(named(column).cast("string")).alias("value")).where("value is not null").distinct()
    new = values.join(read_dictionary(spark, table_dir, version), "value", "left_anti")
    # numbered from a checkpoint, so the partition that is replaced is no longer read
    coded = with_row_id(new, order_by=["value"], name="code").select(
        "value", (F.col("code") + first).alias("code"), F.lit(version).cast("long").alias("version"))
    (coded.write.mode("overwrite").partitionBy("version")
          .option("partitionOverwriteMode", "dynamic").parquet(table_dir))
