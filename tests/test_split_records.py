"""Records over several lines, read in many splits, against Spark's one-task reader."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from colsense.sources.csv import dropped_rows, read_csv
from colsense.sources.records import ends_quoted, in_file_order, read_records, split_states

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def use(size):
        spark.conf.set(SPLIT, str(size))

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def one_task(spark, path, width, header=False):
    fields = [f"c{i}" for i in range(width)]
    df = (spark.read.schema(", ".join(f"{c} string" for c in [*fields, "bad"])).option("multiLine", "true").option("quote", '"')
          .option("escape", '"').option("header", str(header).lower()).option("columnNameOfCorruptRecord", "bad").csv(path))
    return [tuple(r)[:-1] for r in df.collect()]


CELLS = ["", "a", "1,5", 'say "x"', "two\nlines", "\n\n", '"', '""', "\r\nx", ",\n,", "é", " b ", "x" * 40, '\n"\n', "漢\n字"]


def well_formed(rng, rows, width, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    for _ in range(rows):
        w.writerow([rng.choice(CELLS) for _ in range(width - 1)] + ["end"])
    return out.getvalue()


def ragged(rng, rows):
    """Odd text too: plain fields with quotes, text after a closing quote, blank and short lines."""
    odd = ['a"b,c,d', '"ab"c,d,e', ' "x",y,z', "", "p,q", 'a""b,"c\nd",e', '"",,""', '"x"y"z,1,2', "1,2,3,4", '"a\n,b",2,3', "\t,,"]
    return "\n".join(rng.choice(odd) for _ in range(rows)) + "\n"


@pytest.mark.parametrize("size", [25, 200])
def test_many_splits_equal_one_task(spark, tmp_dir, small_splits, size):
    rng = random.Random(size)
    for i, text in enumerate([well_formed(rng, 20, 3), well_formed(rng, 20, 3, "\r\n"), "1,2,3\n" + ragged(rng, 40), "1,2,3\n" + ragged(rng, 20) + '"never\nclosed,1\n2']):
        path = os.path.join(tmp_dir, f"f{i}.csv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        small_splits(1 << 27)
        want = one_task(spark, path, 3)
        small_splits(size)
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        df = read_csv(spark, path, has_headers=False, multiline=True, drop_long_rows=False)
        names = [c for c in df.columns if c != "row_id"]
        got = df.select("row_id", *names[:3]).orderBy("row_id").collect()
        assert [r.row_id for r in got] == list(range(len(got)))
        if i == 1:  # the reader takes the first line break it sees for that of records, and changes it in fields
            want = [tuple(c or None for c in r) for r in csv.reader(io.StringIO(text, newline=""))]
        if i == 3:  # the reader keeps the file's last line break in a field that is never closed
            want[-1] = tuple(None if c is None else c.rstrip("\n") for c in want[-1])
        assert [tuple(r)[1:] for r in got] == want


def test_names_long_rows_and_headers(spark, tmp_dir, small_splits):
    small_splits(16)
    for name, body in (("b.csv", '1,"x\ny"\n\n1,2,3\n5\n'), ("a.csv", '"p\nq",6\n7,8\n')):
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write('a,"b\nc"\n' + body)
    df = read_csv(spark, tmp_dir, multiline=True)
    assert df.columns == ["row_id", "a", "b\nc"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [
        (0, "p\nq", "6"), (1, "7", "8"), (2, "1", "x\ny"), (3, "5", None)]
    counts = {os.path.basename(r.path): (r.n_rows, r.n_dropped) for r in dropped_rows(spark, tmp_dir, multiline=True).collect()}
    assert counts == {"a.csv": (2, 0), "b.csv": (3, 1)}
    with open(os.path.join(tmp_dir, "c.csv"), "w") as f:
        f.write("a,other\n1,2\n")
    with pytest.raises(Exception, match="headers differ"):
        read_csv(spark, tmp_dir, multiline=True, row_id=None).collect()


def test_one_field_over_many_splits(spark, tmp_dir, small_splits):
    path = os.path.join(tmp_dir, "long.csv")
    big = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(2000))
    with open(path, "w") as f:
        f.write(f'h,i\n1,2\n"{big}",3\n4,5\n')
    small_splits(512)
    got = [tuple(r) for r in read_csv(spark, path, multiline=True).orderBy("row_id").collect()]
    assert got == [(0, "1", "2"), (1, big.replace('""', '"'), "3"), (2, "4", "5")]


def test_encoded_records(spark, tmp_dir, small_splits):
    path = os.path.join(tmp_dir, "latin.csv")
    with open(path, "w", encoding="iso-8859-1") as f:
        f.write('n,t\n1,"é\nü"\n2,ß\n')
    small_splits(8)
    got = read_csv(spark, path, encoding="iso-8859-1", multiline=True, row_id=None)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "é\nü"), ("2", "ß")]


def test_changed_splits_raise(spark, tmp_dir, small_splits):
    path = os.path.join(tmp_dir, "x.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + '1,"x\ny"\n' * 50)
    small_splits(50)
    df = read_records(spark, path)
    small_splits(30)
    with pytest.raises(Exception, match="changed while its records were read"):
        df.collect()


def test_line_ends(spark):
    lines = [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a"', False, False), ('"a""', True, False),
             (',"', True, False), ('a,"b', True, False), ('"a"b,"c', True, True), ('x"y,z', False, False), ("", False, True), ('""', False, True)]
    df = spark.createDataFrame([(x,) for x, _, _ in lines], "t string")
    got = df.select("t", ends_quoted(F.col("t"), ",", False).alias("a"), ends_quoted(F.col("t"), ",", True).alias("b")).collect()
    assert [tuple(r) for r in got] == lines
    wide = spark.createDataFrame([('"x",' * 20000 + '"',)], "t string")
    assert wide.select(ends_quoted(F.col("t"), ",", False).alias("a")).first().a is True


def test_no_lines(spark, tmp_dir):
    open(os.path.join(tmp_dir, "e.csv"), "w").close()
    assert read_records(spark, tmp_dir).count() == 0
    assert in_file_order(read_records(spark, tmp_dir), "row_id").count() == 0
    assert split_states(spark.createDataFrame([], "file string, start long, from_start boolean, from_quoted boolean")) == {}
