"""Quoted fields, odd separators and names, exact overrides, centuries."""

import os

import pytest
from pyspark.sql import functions as F

from colsense import DataTypeError, convert, dropped_rows, infer_types, merge_chunk_types, chunk_types, preview_json, read_csv, write_csv
from colsense.functions.datetime import to_datetime
from colsense.operators.overrides import override_fails, override_value


def _file(tmp_dir, text, name="a.csv"):
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_doubled_quotes(spark, tmp_dir):
    path = _file(tmp_dir, 'a,b\n"He said ""hi""",1\n"x, ""y"", z",2\n"C:\\",3\n')
    got = [tuple(r) for r in read_csv(spark, path, row_id=None).collect()]
    assert got == [('He said "hi"', "1"), ('x, "y", z', "2"), ("C:\\", "3")]


def test_written_text_reads_back(spark, tmp_dir):
    rows = [('a "b", c', "1"), ("\\", "2"), ('""', "3")]
    out = os.path.join(tmp_dir, "w.csv")
    write_csv(spark.createDataFrame(rows, "a string, b string").coalesce(1), out)
    assert sorted(tuple(r) for r in read_csv(spark, out, row_id=None).collect()) == sorted(rows)


def test_long_quoted_field_in_a_short_row(spark, tmp_dir):
    path = _file(tmp_dir, "a,b\n\"" + 'x""' * 300_000 + "\"\n1,2\n1,2,3\n")
    got = read_csv(spark, path, row_id=None).select(F.length("a"), "b").collect()
    assert [tuple(r) for r in got] == [(600_000, None), (1, "2")]


def test_pipe_separator(spark, tmp_dir):
    path = _file(tmp_dir, "a|b|c\n1|2\n1|2|3\n1|2|3|4\n")
    assert read_csv(spark, path, row_id=None, sep="|").count() == 2


def test_dotted_names(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(30)], "`price.usd` string, `a.1` string").withColumn("row_id", F.expr("uuid()"))
    types = infer_types(df.drop("row_id"))
    assert {r["column"]: r["inferred_type"] for r in types.collect()}["price.usd"] == "Int64"
    out = convert(df, types, keep=["row_id"])
    assert dict(out.dtypes)["price.usd"] == "bigint" and preview_json(out).count() == 30


def test_merged_types_convert(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("v"))
    merged = merge_chunk_types(chunk_types(df, chunk_rows=20))
    assert dict(convert(df, merged, keep=["row_id"]).dtypes)["v"] == "bigint"


def test_bigint_override_keeps_digits_and_reports_fractions(spark):
    rows = [("9007199254740993", 9007199254740993, False), ("2.5", None, True), ("3.0", 3, False), ("x", None, False),
            ("9223372036854775808", None, True), (None, None, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    got = df.select("v", override_value("v", "Int64").alias("x"), F.coalesce(override_fails("v", "Int64"), F.lit(False)).alias("bad"))
    assert [tuple(r) for r in got.collect()] == rows


@pytest.mark.parametrize("text, want", [
    ("01/02/99", "1999-01-02 00:00:00"), ("01/02/68", "2068-01-02 00:00:00"), ("12/31/69", "1969-12-31 00:00:00"),
    ("1/2/2024 3:04 PM", "2024-01-02 15:04:00"), ("02-Jan-2024", "2024-01-02 00:00:00"),
    ("January 2024", "2024-01-01 00:00:00"), ("20240102T030405", "2024-01-02 03:04:05"),
    ("Jan 2, 2024 3:04 PM", "2024-01-02 15:04:00")])
def test_everyday_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(to_datetime("v").cast("string").alias("x")).first().x == want


def test_line_breaks_inside_quotes(spark, tmp_dir):
    path = _file(tmp_dir, '"a\nb",c\n"line1\nline2",1\n"x, ""y""\n",2\n1,2,"3\n4"\n')
    got = read_csv(spark, path, multiline=True)
    assert got.columns == ["row_id", "a\nb", "c"]
    assert [tuple(r) for r in got.orderBy("row_id").collect()] == [(0, "line1\nline2", "1"), (1, 'x, "y"\n', "2")]


def test_dropped_rows_are_counted(spark, tmp_dir):
    _file(tmp_dir, "a,b\n1,2\n1,2,3\n1\n", "x.csv")
    _file(tmp_dir, "a,b\n1,2\n", "y.csv")
    got = {r["path"][-5:]: (r["n_rows"], r["n_dropped"]) for r in dropped_rows(spark, tmp_dir).collect()}
    assert got == {"x.csv": (3, 1), "y.csv": (1, 0)} and read_csv(spark, tmp_dir, row_id=None).count() == 3


@pytest.mark.parametrize("head", ["b,a", "a,b,c", "a"])
def test_other_header_in_a_file_fails(spark, tmp_dir, head):
    _file(tmp_dir, "a,b\n1,2\n", "x.csv")
    _file(tmp_dir, head + "\n1,2\n", "y.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, tmp_dir, row_id=None).collect()


def test_other_header_with_repeated_names_fails(spark, tmp_dir):
    _file(tmp_dir, "a,a\n1,2\n", "x.csv")
    assert read_csv(spark, tmp_dir, row_id=None).columns == ["a", "a.1"]
    _file(tmp_dir, "a,b\n1,2\n", "y.csv")
    with pytest.raises(DataTypeError):
        read_csv(spark, tmp_dir, row_id=None)


def test_written_blanks_stay(spark, tmp_dir):
    out = os.path.join(tmp_dir, "w.csv")
    write_csv(spark.createDataFrame([(" a ", "\tb")], "a string, b string"), out)
    assert [tuple(r) for r in read_csv(spark, out, row_id=None).collect()] == [(" a ", "\tb")]
