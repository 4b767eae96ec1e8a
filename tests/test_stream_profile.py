"""The typing stream reads as read_csv does; profiles of parts merge to that of the whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from colsense import infer_types, read_csv
from colsense.functions import vocab as V
from colsense.operators.mergeable import add_to_profile, merge_profiles, stored_profile
from colsense.operators.profile import PROFILE_FIELDS, profile
from colsense.streaming import (batch_types, merged_stream_errors, merged_stream_types, start_typing_stream, stream_batches,
                                stream_errors, stream_types)


def write(folder, name, rows, header="a,b,c"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write("\n".join([header, *rows]) + "\n")


@pytest.fixture()
def folder(tmp_dir):
    rng = random.Random(1)
    src = os.path.join(tmp_dir, "src")
    for n in range(3):
        write(src, f"f{n}.csv", [f'"say ""x{rng.random()}"", 1000",{rng.randint(0, 10**6)},{rng.choice(["yes", "no", "NA", ""])}' for _ in range(60)]
              + ["1,2,3,4", "short,7", '"x,y",8,no,"too ""long"""'][:n + 1])
    return src, os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ck")


def test_stream_types_as_read_csv(spark, folder):
    src, table, ck = folder
    start_typing_stream(spark, src, ["a", "b", "c"], table, checkpoint=ck, max_files_per_trigger=1).awaitTermination()
    whole = {r["column"]: r.asDict() for r in infer_types(read_csv(spark, src), row_id="row_id").collect()}
    got = {r["column"]: r.asDict() for r in stream_types(spark, table).collect()}
    assert {c: r["inferred_type"] for c, r in got.items()} == {"a": V.OBJECT, "b": V.INT, "c": V.BOOL}
    for c, r in got.items():
        assert {k: r[k] for k in ("inferred_type", *PROFILE_FIELDS)} == {k: whole[c][k] for k in ("inferred_type", *PROFILE_FIELDS)}
    assert {r["column"]: (r["inferred_type"], r["n_chunks"]) for r in merged_stream_types(spark, table).collect()} == {
        "a": (V.OBJECT, 3), "b": (V.INT, 3), "c": (V.BOOL, 3)}
    assert sorted((r.n_rows, r.n_dropped) for r in stream_batches(spark, table).collect()) == [(61, 1), (62, 1), (63, 2)]
    assert stream_errors(spark, table).count() == 0 and merged_stream_errors(spark, table).count() == 0
    # no new file, no new batch; a new one is merged
    start_typing_stream(spark, src, ["a", "b", "c"], table, checkpoint=ck).awaitTermination()
    assert batch_types(spark, table).count() == 9
    write(src, "f9.csv", ["text,4.5,maybe"] * 5)
    start_typing_stream(spark, src, ["a", "b", "c"], table, checkpoint=ck).awaitTermination()
    got = {r["column"]: (r["inferred_type"], r["n_rows"]) for r in stream_types(spark, table).collect()}
    assert got["b"] == (V.FLOAT, 187) and got["c"][0] == V.CATEGORY
    # the whole stream once more, as after a lost checkpoint: batches are replaced, not added
    before = sorted(map(str, stream_batches(spark, table).collect()))
    start_typing_stream(spark, src, ["a", "b", "c"], table, max_files_per_trigger=1).awaitTermination()
    assert stream_batches(spark, table).count() == len(before) == 4
    assert {r["column"]: r["n_rows"] for r in stream_types(spark, table).collect()} == {"a": 187, "b": 187, "c": 187}


def test_stream_errors_by_batch(spark, tmp_dir):
    src, table = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "table")
    write(src, "a.csv", ["1,x", "2,y"], "n,s")
    write(src, "b.csv", ["3,x", "four,y", "five,z,too,long", "six,z"], "n,s")
    start_typing_stream(spark, src, ["n", "s"], table, overrides={"n": "int64"}, max_files_per_trigger=1).awaitTermination()
    rows = stream_errors(spark, table).collect()
    assert [(r["column"], r["requested_type"], r["sample_values"]) for r in rows] == [("n", "int64", ["3", "four", "six"])]
    assert merged_stream_errors(spark, table).count() == 1
    whole = stream_types(spark, table, {"n": "int64"}).where("column = 'n'").first()
    assert whole["override_failed"] and whole["n_override_fail"] == 2 and whole["n_rows"] == 5


def test_other_header_fails(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    write(src, "a.csv", ["1,2"], "x,y")
    with pytest.raises(Exception):
        start_typing_stream(spark, src, ["x", "z"], os.path.join(tmp_dir, "t")).awaitTermination()


def test_line_breaks_and_encoding(spark, tmp_dir):
    src, table = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "table")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w", encoding="iso-8859-1") as f:
        f.write('é,n\n"two\nlines",1\n"ß, x",2\n')
    start_typing_stream(spark, src, ["é", "n"], table, encoding="iso-8859-1", multiline=True).awaitTermination()
    assert {r["column"]: (r["inferred_type"], r["n_rows"]) for r in stream_types(spark, table).collect()}["n"] == (V.INT, 2)


def test_parts_merge_to_the_whole(spark, tmp_dir):
    rng = random.Random(3)
    rows = [(str(i), rng.choice(["yes", "no", None]), rng.choice(["1", "2.5", "x", "", "NA"]), "2024-01-%02d" % (i % 28 + 1),
             "long " * 40 + str(i % 50), rng.choice(["3+4j", "1"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    whole = {r["column"]: r.asDict() for r in profile(df).collect()}
    table = os.path.join(tmp_dir, "profile")
    for batch, part in enumerate((df.where("CAST(a AS INT) < 500"), df.where("CAST(a AS INT) BETWEEN 500 AND 2900"),
                                  df.where("CAST(a AS INT) > 2900"), df.where("false"))):
        add_to_profile(part, table, batch)
    add_to_profile(df.where("CAST(a AS INT) < 500"), table, 0)  # again
    merged = stored_profile(spark, table)
    for r in merged.collect():
        want = whole[r["column"]]
        assert {k: r[k] for k in PROFILE_FIELDS if k != "n_distinct"} == {k: want[k] for k in PROFILE_FIELDS if k != "n_distinct"}
        assert abs(r["n_distinct"] - want["n_distinct"]) <= 0.03 * want["n_distinct"]
        assert r["n_distinct"] == want["n_distinct"] or want["n_distinct"] > 1000
    again = merge_profiles(merged.withColumn("g", F.lit(1)), ["g"])
    assert sorted(map(str, again.select(merged.columns).drop("distinct_sketch").collect())) == sorted(
        map(str, merged.drop("distinct_sketch").collect()))
