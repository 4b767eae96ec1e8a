"""FIXTURES F3 (overrides) and F4 (chunks)."""

from pyspark.sql import functions as F

from colsense import chunk_errors, chunk_types, infer_and_convert, merge_chunk_errors, merge_chunk_types


def _orders_dirty(spark):
    rows = []
    for i in range(20):
        rows.append((i, "$5" if i == 3 else f"{i}.25",
                     "not a date" if i == 7 else f"2024-03-{i + 1:02d}",
                     "False" if i % 2 else "True", f"{i} days"))
    return spark.createDataFrame(rows, "row_id long, price string, `when` string, flag string, wait string")


def test_overrides(spark):
    df = _orders_dirty(spark)
    ov = {"price": "float64", "when": "datetime64[ns]", "flag": "bool", "wait": "timedelta64[ns]",
          "nope": "float64"}
    res = infer_and_convert(df, overrides=ov, row_id="row_id")
    types = {r["column"]: r for r in res.types.collect()}
    assert types["price"]["inferred_type"] == "float64" and not types["price"]["override_failed"]
    assert types["when"]["override_failed"] and types["when"]["inferred_type"] == "datetime64[ns]"
    assert types["flag"]["inferred_type"] == "bool"
    assert types["wait"]["inferred_type"] == "timedelta64[ns]"
    data = {r["row_id"]: r for r in res.data.collect()}
    assert data[3]["price"] is None          # numeric override: raw value, no currency handling
    assert data[2]["price"] == 2.25
    assert data[1]["flag"] is False          # 'False' is false (fix of truthiness)
    assert data[7]["when"] is None
    errors = res.errors.collect()
    assert len(errors) == 1
    e = errors[0]
    assert e["column"] == "when" and e["requested_type"] == "datetime64[ns]"
    assert e["error"] == "could not convert 1 value(s) to datetime64[ns]"
    assert e["sample_values"] == [f"2024-03-{d:02d}" for d in range(1, 6)]


def test_unsupported_override_is_an_error_row(spark):
    df = _orders_dirty(spark)
    res = infer_and_convert(df, overrides={"price": "decimal"}, row_id="row_id")
    (e,) = res.errors.collect()
    assert e["error"] == "data type 'decimal' not understood"
    assert {r["column"]: r["inferred_type"] for r in res.types.collect()}["price"] == "float64"


def test_chunks_and_merge(spark):
    rows = []
    for i in range(60):
        chunk = i // 20
        a = str(i)
        b = str(i) if chunk == 0 else f"text {i}"
        c = None if chunk == 1 else str(i * 3)
        rows.append((i, a, b, c))
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    ct = chunk_types(df, "row_id", 20)
    per = {(r["chunk_id"], r["column"]): r["inferred_type"] for r in ct.collect()}
    assert per[(0, "b")] == "Int64" and per[(1, "b")] == "object"
    assert per[(1, "c")] == "object"
    merged = {r["column"]: r["inferred_type"] for r in merge_chunk_types(ct).collect()}
    assert merged == {"a": "Int64", "b": "object", "c": "object"}


def test_chunk_errors_latest_wins(spark):
    rows = [(i, "oops" if i in (5, 45) else f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, d string")
    ov = {"d": "datetime64[ns]"}
    ct = chunk_types(df, "row_id", 20, overrides=ov)
    errs = chunk_errors(df, ct, "row_id", 20)
    assert sorted(r["chunk_id"] for r in errs.collect()) == [0, 2]
    (m,) = merge_chunk_errors(errs).collect()
    assert m["chunk_id"] == 2 and m["sample_values"][0] == "2024-01-13"


def test_complex_override_accepts_complex_grammar(spark):
    vals = ["3+4i", "(5)", "2j", "( 1-2j )", "7", None, "NaN"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "row_id long, z string")
    res = infer_and_convert(df, overrides={"z": "complex128"}, row_id="row_id")
    (t,) = res.types.collect()
    assert not t["override_failed"] and t["inferred_type"] == "complex128"
    got = {r["row_id"]: (r["z"]["re"], r["z"]["im"]) if r["z"] else None for r in res.data.collect()}
    assert got[0] == (3.0, 4.0) and got[1] == (5.0, 0.0) and got[2] == (0.0, 2.0)
    assert got[3] == (1.0, -2.0) and got[4] == (7.0, 0.0) and got[5] is None
    bad = spark.createDataFrame([(0, "3 + 4i"), (1, "1")], "row_id long, z string")
    (e,) = infer_and_convert(bad, overrides={"z": "complex128"}, row_id="row_id").errors.collect()
    assert e["sample_values"] == ["3 + 4i", "1"]


def test_category_codes_both_join_paths(spark):
    from colsense import category_codes, category_dictionary
    df = spark.createDataFrame([(i, ["b", "a", "c", "NA"][i % 4]) for i in range(40)], "row_id long, v string")
    d = {r["value"]: r["code"] for r in category_dictionary(df, "v").collect()}
    assert d == {"a": 0, "b": 1, "c": 2}
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)

    def codes(threshold):
        spark.conf.set(limit, threshold)
        return sorted((r["row_id"], r["v_code"]) for r in category_codes(df, "v").collect())

    try:
        a, b = codes("10m"), codes("-1")
    finally:
        spark.conf.set(limit, before)
    assert a == b and a[0] == (0, 1) and a[3] == (3, None)
