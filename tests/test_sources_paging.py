"""FIXTURES F5 (files) and F6 (paging), row ids and the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from colsense import (DataTypeError, audit_encodings, page, preview_json, read_csv, with_row_id)
from colsense.sources.csv import header_names


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def test_header_repair():
    assert header_names(["a", "a", "", "b"]) == ["a", "a.1", "Unnamed: 2", "b"]


def test_ragged_rows(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "ragged.csv"),
               'a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12,\n"x,y",13,14\n')
    rows = [r.asDict() for r in read_csv(spark, p).orderBy("row_id").collect()]
    assert rows == [
        {"row_id": 0, "a": "1", "b": "2", "c": "3"},
        {"row_id": 1, "a": "4", "b": "5", "c": None},
        {"row_id": 2, "a": "x,y", "b": "13", "c": "14"},
    ]


def test_headerless_and_duplicates(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "h.csv"), "1,2\n3,4\n")
    assert read_csv(spark, p, has_headers=False).columns == ["row_id", "Column_1", "Column_2"]
    q = _write(os.path.join(tmp_dir, "d.csv"), "a,a,,b\n1,2,3,4\n")
    assert read_csv(spark, q).columns == ["row_id", "a", "a.1", "Unnamed: 2", "b"]


def test_not_csv_is_rejected(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "x.txt"), "a\n1\n")
    with pytest.raises(DataTypeError):
        read_csv(spark, p)


def test_encodings(spark, tmp_dir):
    d = os.path.join(tmp_dir, "enc")
    os.makedirs(d)
    _write(os.path.join(d, "u8.csv"), "name\ncafé\n")
    _write(os.path.join(d, "bom.csv"), "﻿name\ncafé\n")
    _write(os.path.join(d, "cp.csv"), "name\ncafé – ok\n", encoding="cp1252")
    late = "name\n" + "x\n" * 6000 + "naïve\n"
    _write(os.path.join(d, "late.csv"), late, encoding="latin-1")
    got = {os.path.basename(r["path"]): r["encoding"] for r in audit_encodings(spark, d).collect()}
    # the line reader strips a UTF-8 BOM, so utf-8 is the right reader setting
    assert got == {"u8.csv": "utf-8", "bom.csv": "utf-8", "cp.csv": "cp1252", "late.csv": "cp1252"}
    assert read_csv(spark, os.path.join(d, "bom.csv")).columns == ["row_id", "name"]
    rows = read_csv(spark, os.path.join(d, "cp.csv"), encoding="cp1252").collect()
    assert rows[0]["name"] == "café – ok"


def test_paging(spark):
    df = spark.range(25).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("k"))
    sizes = [page(df, p, 10).count() for p in (1, 2, 3, 4)]
    assert sizes == [10, 10, 5, 0]
    assert [r["row_id"] for r in page(df, 2, 10).collect()] == list(range(10, 20))
    with pytest.raises(ValueError):
        page(df, 0, 10)


def test_preview_json(spark):
    df = spark.sql("""SELECT 0L AS row_id, 1L AS k, timestamp_ntz'2024-01-02 03:04:05' AS ts,
                      CAST(NULL AS DOUBLE) AS d, true AS ok,
                      make_dt_interval(2, 12, 0, 0) AS wait,
                      named_struct('re', 3.0D, 'im', 4.0D) AS z""")
    rec = json.loads(preview_json(df).collect()[0]["json"])
    assert rec == {"k": 1, "ts": "2024-01-02T03:04:05.000", "d": None, "ok": True,
                   "wait": "P2DT12H0M0S", "z": "(3+4j)"}


def test_row_ids_contiguous(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    ids = with_row_id(df, order_by=["k"])
    rows = ids.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000))
    assert all(r["row_id"] == r["k"] for r in rows)
    plain = with_row_id(spark.range(0, 300, 1, 4).toDF("k"))
    assert sorted(r["row_id"] for r in plain.collect()) == list(range(300))


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_stream_query_has_eight_chunks_however_rows_are_dealt(spark, partitions):
    from colsense.plans.catalog import QUERIES
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = QUERIES["stream_chunk_types"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == 6 and {r["n_chunks"] for r in got} == {8}


def test_stream_is_idempotent_per_batch(spark, tmp_dir):
    from colsense.streaming import batch_types, merged_stream_types, start_typing_stream
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), "x,y\n" + "".join(f"{i},{i}.5\n" for i in range(30)))
    _write(os.path.join(src, "b.csv"), "x,y\n" + "".join(f"{i},w{i}\n" for i in range(30)))
    table = os.path.join(tmp_dir, "types")
    ck = os.path.join(tmp_dir, "ck")
    start_typing_stream(spark, src, ["x", "y"], table, checkpoint=ck, max_files_per_trigger=1).awaitTermination()
    assert batch_types(spark, table).count() == 4
    merged = {r["column"]: r["inferred_type"] for r in merged_stream_types(spark, table).collect()}
    assert merged == {"x": "Int64", "y": "object"}
    # a second run over the same checkpoint adds nothing
    start_typing_stream(spark, src, ["x", "y"], table, checkpoint=ck).awaitTermination()
    assert batch_types(spark, table).count() == 4


def test_forced_encoding_drops_undecodable(spark, tmp_dir):
    p = os.path.join(tmp_dir, "latin.csv")
    with open(p, "wb") as f:
        f.write("name\ncaf\xe9 ok\n".encode("latin-1"))
    rows = read_csv(spark, p, encoding="utf-8").collect()
    assert rows[0]["name"] == "caf ok"


def test_response_bundle(spark):
    from colsense import infer_and_convert, response
    df = spark.createDataFrame([(i, str(i), "x" if i == 4 else f"2024-01-{i + 1:02d}") for i in range(12)],
                               "row_id long, n string, d string")
    res = infer_and_convert(df, overrides={"d": "datetime64[ns]"}, row_id="row_id")
    r = response(res.types, res.errors, res.data, page_no=2, page_size=5)
    assert r.total_rows == 12 and r.failed
    assert [json.loads(x["json"])["n"] for x in r.preview.collect()] == [5, 6, 7, 8, 9]


def test_bad_column_does_not_disturb_others(spark):
    from colsense import infer_and_convert
    weird = ["\x00", "((((", "1e999999", "j" * 500, "--5", "P1e400D", "💥"]
    df = spark.createDataFrame([(i, str(i * 3), weird[i % len(weird)]) for i in range(40)],
                               "row_id long, good string, weird string")
    res = infer_and_convert(df, row_id="row_id")
    types = {r["column"]: r["inferred_type"] for r in res.types.collect()}
    assert types["good"] == "Int64"
    assert res.data.count() == 40 and res.errors.count() == 0
