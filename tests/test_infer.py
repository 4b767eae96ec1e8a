"""FIXTURES F2: column cases -> inferred type, and decision boundaries."""

import pytest
from pyspark.sql import functions as F

from colsense import infer_types


def _infer(spark, values, partitions=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, v string")
    if partitions:
        df = df.repartition(partitions)
    rows = infer_types(df, row_id="row_id").collect()
    assert len(rows) == 1
    return rows[0]["inferred_type"]


def test_all_missing_is_object(spark):
    assert _infer(spark, [None, "NA", "--", "  ", "n/a"]) == "object"


def test_boolean_spellings_with_nulls(spark):
    assert _infer(spark, ["yes", "no", "1", "0", None, "NA"]) == "bool"


def test_numeric_ratio_inclusive_at_80_percent(spark):
    vals = [str(i) for i in range(16)] + [f"w{i}x" for i in range(4)]
    assert _infer(spark, vals) == "Int64"


def test_numeric_ratio_below_80_percent_distinct_text(spark):
    vals = [str(i + 100) for i in range(15)] + [f"word{i}" for i in range(5)]
    assert _infer(spark, vals) == "object"


@pytest.mark.parametrize("vals,want", [
    (["1", "2", "3.0"], "Int64"),
    (["1", "2.5"], "float64"),
    (["1", "2+1j"], "complex128"),
    (["9007199254740993", "1"], "Int64"),
])
def test_number_kinds(spark, vals, want):
    # padded with distinct numbers so the column is not categorical first
    assert _infer(spark, vals * 1) == want


def test_big_integer_keeps_digits(spark):
    from colsense import infer_and_convert
    df = spark.createDataFrame([(0, "9007199254740993"), (1, "2")], "row_id long, v string")
    res = infer_and_convert(df, row_id="row_id")
    assert res.data.orderBy("row_id").collect()[0]["v"] == 9007199254740993


@pytest.mark.parametrize("n,limit", [(10, 3), (100, 10), (1000, 20)])
def test_category_count_bounds(spark, n, limit):
    # distinct ratio above the ratio limit, distinct count exactly at / past the count limit
    at = [f"v{i % limit}" for i in range(n)]
    past = [f"v{i % (limit + 1)}" for i in range(n)]
    ratio_at = limit / n
    assert _infer(spark, at) == "category"
    expected_past = "category" if (limit + 1) / n <= {10: 0.5, 100: 0.5, 1000: 0.3}[n] else "object"
    assert _infer(spark, past) == expected_past
    assert ratio_at >= 0


def test_category_boundary_11_rows(spark):
    # 11 rows: ratio limit 0.5 / count 10; 11 distinct -> not categorical
    assert _infer(spark, [f"t{i}" for i in range(11)]) == "object"
    # 10 rows: limit (0.5, 3); 5 distinct of 10 -> ratio 0.5 -> categorical
    assert _infer(spark, [f"t{i % 5}" for i in range(10)]) == "category"


def test_dates_distinct_vs_repeated(spark):
    distinct = [f"2024-01-{d:02d}" for d in range(1, 21)]
    assert _infer(spark, distinct) == "datetime64[ns]"
    repeated = [f"2024-01-{d:02d}" for d in range(1, 11)] * 2
    assert _infer(spark, repeated) == "category"


def test_duration_ratio_is_strict(spark):
    ok18 = [f"{i} days" for i in range(18)] + ["x1y", "x2y"]
    ok19 = [f"{i} days" for i in range(19)] + ["x1y"]
    assert _infer(spark, ok18) == "object"
    assert _infer(spark, ok19) == "timedelta64[ns]"


def test_datetime_ratio_is_strict(spark):
    base = [f"2024-02-{d:02d}" for d in range(1, 21)]
    ok18 = base[:18] + ["never", "later"]
    ok19 = base[:19] + ["never"]
    assert _infer(spark, ok18) == "object"
    assert _infer(spark, ok19) == "datetime64[ns]"


def test_invariant_to_partitioning(spark):
    vals = [str(i * 7 % 50) + ".5" for i in range(200)] + ["NA"] * 5
    assert _infer(spark, vals, partitions=1) == _infer(spark, vals, partitions=7)


def test_clean_missing_idempotent(spark):
    from colsense.functions import clean_missing
    df = spark.createDataFrame([("NA",), ("x",), (" ",), ("tbd",)], "v string")
    once = clean_missing(df)
    twice = clean_missing(once)
    assert once.collect() == twice.collect()


def test_approximate_profile_agrees_on_types(spark):
    df = spark.createDataFrame([(i, str(i % 13), f"2024-01-{i % 28 + 1:02d}") for i in range(500)],
                               "row_id long, a string, b string")
    exact = {r["column"]: r["inferred_type"] for r in infer_types(df, row_id="row_id").collect()}
    approx = {r["column"]: r["inferred_type"] for r in infer_types(df, row_id="row_id", exact=False).collect()}
    assert exact == approx


def test_hot_value_holding_a_third_of_rows(spark):
    """One value holds a third of the rows: counts stay exact and the decision
    sees every row (map-side partial aggregation absorbs the hot value)."""
    from colsense import profile
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") * 31).cast("string")).alias("v"))
    p = profile(df.repartition(6), ["v"]).collect()[0]
    assert p["n_rows"] == n and p["n_non_null"] == n and p["n_numeric"] == n
    assert p["n_distinct"] == 2 * n // 3 + 1
    assert infer_types(df, row_id="row_id").collect()[0]["inferred_type"] == "Int64"


def test_long_text_values_are_hashed_not_lost(spark):
    from colsense import profile
    long_a = "word " * 60
    long_b = "text " * 60
    df = spark.createDataFrame([(i, long_a if i % 2 else long_b) for i in range(40)], "row_id long, v string")
    p = profile(df, ["v"]).collect()[0]
    assert p["n_rows"] == 40 and p["n_distinct"] == 2


def test_columns_named_like_internal_fields(spark):
    df = spark.createDataFrame([(i, str(i), f"k{i % 3}", "yes" if i % 2 else "no", str(i) + ".5")
                                for i in range(30)],
                               "row_id long, column string, key string, value string, cnt string")
    got = {r["column"]: r["inferred_type"] for r in infer_types(df, row_id="row_id").collect()}
    assert got == {"column": "Int64", "key": "category", "value": "bool", "cnt": "float64"}
    from colsense import chunk_types
    assert chunk_types(df, "row_id", 10).count() == 12


def test_approximate_profile_counts_equal_flags_first(spark):
    """Rows are grouped by their flags before any other aggregate; the result is that of the exact profile."""
    from colsense.operators.profile import PROFILE_FIELDS, profile
    words = ["A", "N", "i", "J", "ten", "TenDays", "tend\n", "ten\n", "na", "Null", "yes", " no", "x1", "5 days", "2021-01-05", "$1.50", "7", None, ""]
    df = spark.createDataFrame([(w, words[i // 3]) for i, w in enumerate(words * 3)], "a string, b string")
    found = profile(df, exact=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [column" in plan and any(", f#" in x.split("]")[0] for x in plan.split("Aggregate [column")[1:])
    fields = ["column", *PROFILE_FIELDS]
    assert sorted(map(tuple, found.select(fields).collect()), key=str) == sorted(map(tuple, profile(df).select(fields).collect()), key=str)


def test_text_that_is_no_number_reaches_no_cast(spark):
    """A cast that fails throws: the guard comes before it."""
    from colsense.functions.text import guarded_double
    df = spark.createDataFrame([("x",), ("1e3",), (" 5 ",), (None,)], "v string").select(guarded_double("v").alias("d"))
    assert "CASE WHEN" in df._jdf.queryExecution().analyzed().toString()
    assert [r.d for r in df.collect()] == [None, 1000.0, 5.0, None]
