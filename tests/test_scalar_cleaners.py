"""FIXTURES F1: one row per scalar case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colsense.functions import (DATETIME_FORMATS, duration_days, is_missing_pattern, is_missing_token, numeric_parts,
                                to_bool, to_datetime)


def _run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_missing_exact(spark):
    vals = ["NA", "NaN", "--", "?", "(empty)", "pending", " NA ", "nan", "None", "#N/A"]
    got = _run(spark, vals, is_missing_token)
    assert got == [True, True, True, True, True, True, False, True, True, True]


def test_missing_pattern(spark):
    vals = ["NULL", "Tbd", "N/a", "----", "   ", "Not   Available", "?x", "nullable", "\t ", "x"]
    got = _run(spark, vals, is_missing_pattern)
    assert got == [True, True, True, True, True, True, False, False, True, False]


NUMERIC_CASES = [
    ("$1,234.50", 1234.5), ("-€5", -5.0), ("5 £", 5.0), ("-5€", -5.0), ("$-5", None),
    ("USD 5", None), ("$12 per month", 12.0), ("$5%", 5.0),
    ("50%", 0.5), ("5 %", 0.05), ("1,000%", None),
    ("1e5", 100000.0), ("-2.5E-3", -0.0025), ("1,000e3", None), ("e", None),
    ("1,234,567", 1234567.0), ("1.234.567", 1234.567), ("192.168.1.1", 1921681.1),
    ("5d", None), ("5f", None), ("0x1p3", None), ("nan", None), ("1_000", None),
    ("  42 ", 42.0), ("abc 12€", None), (".5", 0.5), ("5.", 5.0),
]


@pytest.mark.parametrize("currency_codes", [False])
def test_numeric(spark, currency_codes):
    got = _run(spark, [c for c, _ in NUMERIC_CASES], lambda c: numeric_parts(c)["value"])
    for (case, want), g in zip(NUMERIC_CASES, got):
        assert g == want, (case, g, want)


COMPLEX_CASES = [
    ("3+4i", (3.0, 4.0)), ("3+4 j", (3.0, 4.0)), ("i", (0.0, 1.0)), ("-i", (0.0, -1.0)),
    ("3 + 4i", None), ("inf", None), ("(1-2j)", (1.0, -2.0)), ("2.5j", (0.0, 2.5)),
    ("1e2+j", (100.0, 1.0)), ("5 million", None),
]


def test_complex(spark):
    got = _run(spark, [c for c, _ in COMPLEX_CASES],
               lambda c: F.when(numeric_parts(c)["cplx"],
                                F.struct(numeric_parts(c)["re"], numeric_parts(c)["im"])))
    for (case, want), g in zip(COMPLEX_CASES, got):
        assert (tuple(g) if g is not None else None) == want, (case, g)


def test_boolean(spark):
    spellings = ["true", "false", "yes", "no", "y", "n", "t", "f", "1", "0", "on", "off", "enabled",
                 "disabled", "active", "inactive", "positive", "negative", "success", "failure",
                 "pass", "fail"]
    vals = [f"  {s.upper()}\t" for s in spellings] + ["maybe"]
    got = _run(spark, vals, to_bool)
    assert got[:-1] == [i % 2 == 0 for i in range(22)]
    assert got[-1] is None


DURATION_CASES = [
    ("P3D", 3.0), ("2.5 days", 2.5), ("-1d", -1.0), ("Eight", 8.0), ("1-2", None),
    ("3 hours", None), ("4 day", 4.0), ("pd", None), ("p1e2d", 100.0), ("--5", None),
]


def test_duration(spark):
    got = _run(spark, [c for c, _ in DURATION_CASES], duration_days)
    for (case, want), g in zip(DURATION_CASES, got):
        assert g == want, (case, g)


DATETIME_CASES = [
    ("2024-01-02", dt.datetime(2024, 1, 2)),
    ("01/02/2024", dt.datetime(2024, 1, 2)),
    ("13/02/2024", dt.datetime(2024, 2, 13)),
    ("Jan 2, 2024", dt.datetime(2024, 1, 2)),
    ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 1, 4, 5)),
    ("2024-03-10 02:30", dt.datetime(2024, 3, 10, 2, 30)),
    ("Mon, 2 Jan 2024 10:00:00 +0200", dt.datetime(2024, 1, 2, 8, 0)),
    ("2024-01-02 03:04:05.123456789", dt.datetime(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-02-30", None), ("now", None), ("10:30", None), ("Monday", None),
]


def test_datetime(spark):
    got = _run(spark, [c for c, _ in DATETIME_CASES], to_datetime)
    for (case, want), g in zip(DATETIME_CASES, got):
        assert g == want, (case, g)


def test_conversion_fast_paths_agree_with_general_cleaner(spark):
    from colsense.functions.numeric import to_bigint
    from colsense.operators.convert import typed_value
    vals = ["0", "007", "42", "123456789012345678", "9007199254740993", "1.5", "20.0", "0.001",
            "2024-01-02", "2024-1-2 3:04", "2024-01-02 03:04:05.123456", "12", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    rows = df.select(
        typed_value("v", "Int64").alias("fi"), to_bigint(numeric_parts("v")).alias("gi"),
        typed_value("v", "float64").alias("ff"), numeric_parts("v")["value"].alias("gf"),
        typed_value("v", "datetime64[ns]").alias("fd"),
        to_datetime(F.col("v"), formats=list(DATETIME_FORMATS))
        .alias("gd")).collect()
    for r in rows:
        assert r["fi"] == r["gi"] and r["ff"] == r["gf"] and r["fd"] == r["gd"], r
