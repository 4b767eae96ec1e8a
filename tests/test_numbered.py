"""Numbered tables: ids that follow from the rows, pages from their own files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from colsense.operators.numbered import manifest, read_numbered, read_page, row_count, write_numbered


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.fixture()
def rows():
    rng = random.Random(2)
    out = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 400), rng.choice(["x", "y"])) for _ in range(900)]
    return out + [(2, 7, "same")] * 700


def test_pages_are_read_from_their_files(spark, tmp_dir, rows):
    want = sorted(rows, key=key)
    names = "k int, `offset` int, `a.b` string"
    for n, parts in enumerate((7, 3)):
        path = os.path.join(tmp_dir, str(n))
        df = spark.createDataFrame(rows[::-1] if n else rows, names).repartition(4 + n)
        write_numbered(df, path, ["k"], rows_per_file=100, num_partitions=parts)
        files = manifest(spark, path).orderBy("first").collect()
        assert [f["first"] for f in files] == [0, *(f["last"] + 1 for f in files[:-1])] and len(files) >= 16
        assert max(f["last"] - f["first"] for f in files) < 100 and row_count(spark, path) == len(rows)
        # equal rows are dealt out as well
        assert len({f["part"] for f in files}) == parts
        for page_no, size in ((1, 25), (7, 33), (2, 700), (65, 25), (1, 5000)):
            page = read_page(spark, path, page_no, size)
            low = (page_no - 1) * size
            assert [tuple(r) for r in page.collect()] == [(i, *want[i]) for i in range(low, min(low + size, len(want)))]
            assert page.columns == ["row_id", "k", "offset", "a.b"]
            read = {f["file"] for f in files if f["last"] >= low and f["first"] < low + size}
            assert len(page.inputFiles()) == len(read) <= size // 100 + 6
        every = read_numbered(spark, path, "id")
        assert [tuple(r) for r in every.orderBy("id").collect()] == [(i, *w) for i, w in enumerate(want)]


def test_no_rows_and_wrong_pages(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    write_numbered(spark.range(0).select(F.col("id").alias("a")), path, ["a"])
    assert row_count(spark, path) == 0 and read_page(spark, path).collect() == []
    assert read_page(spark, path).columns == ["row_id", "a"]
    for bad in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            read_page(spark, path, *bad)
