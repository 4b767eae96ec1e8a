import pytest
from pyspark.sql import functions as F

from colsense.operators.convert import coerced_counts, convert_counted
from colsense.operators.dictionary import extend_dictionary, read_dictionary
from colsense.operators.profile import profile


def _codes(spark, path):
    return {r["value"]: (r["code"], r["version"]) for r in read_dictionary(spark, path).collect()}


def test_codes_stay_when_the_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "codes")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "`a.b` string")
    assert _codes(spark, path) == {}
    extend_dictionary(rows("pear", "NA", None, "fig", "pear"), "a.b", path, 0)
    first = _codes(spark, path)
    assert first == {"fig": (0, 0), "pear": (1, 0)}
    extend_dictionary(rows("apple", "pear", "zebra"), "a.b", path, 1)
    grown = first | {"apple": (2, 1), "zebra": (3, 1)}
    assert _codes(spark, path) == grown
    extend_dictionary(rows("zebra", "apple"), "a.b", path, 1)  # replayed
    assert _codes(spark, path) == grown
    extend_dictionary(rows("fig", None), "a.b", path, 2)
    extend_dictionary(rows("kiwi"), "a.b", path, 3)
    assert _codes(spark, path) == grown | {"kiwi": (4, 3)}
    with pytest.raises(ValueError, match="builds on"):
        extend_dictionary(rows("date"), "a.b", path, 1)


def test_sample_is_exact_and_does_not_depend_on_dealing(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("a"),
                                    F.when(F.col("id") < 40, F.lit("x")).alias("b"), F.lit(None).cast("string").alias("c"),
                                    F.when(F.col("id") % 2 == 0, F.lit("word")).otherwise(F.lit("1")).alias("d"))
    take = lambda df, n: sorted(profile(df, ["a", "b", "c", "d"], sample_rows=n, row_id="row_id")
                                .select("column", "n_sampled", "n_numeric").collect())
    for n in (1, 100, 1999):
        got = take(rows, n)
        assert [r["n_sampled"] for r in got] == [n, min(n, 40), 0, n]
        assert got == take(rows.repartition(7, "d").orderBy(F.desc("row_id")), n)
    assert [r["n_sampled"] for r in take(rows, 5000)] == [2000, 40, 0, 3000]
    assert 20 < take(rows, 100)[3]["n_numeric"] < 80


def test_coerced_values_are_counted_in_the_converting_pass(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "NA", None), (3, "two", "2020-01-01"), (4, None, "")], "id int, `a.b` string, t string")
    types = spark.createDataFrame([("a.b", "Int64"), ("t", "datetime64[ns]")], "column string, inferred_type string")
    data, seen = convert_counted(df, types, keep=["id"])
    assert data.columns == df.columns and len(data.collect()) == 4
    assert {r["column"]: r["n_coerced"] for r in coerced_counts(spark, types, seen).collect()} == {"a.b": 1, "t": 1}
    assert convert_counted(df, {}, keep=["id"])[0].collect() == df.collect()
