"""Encodings by file: the audit's candidates, and mixed folders read as one."""

import os

import pytest

from colsense import audit_encodings, read_csv
from colsense.sources.csv import DataTypeError, dropped_rows

TEXTS = {"utf-8": "é漢字😀", "cp1252": "café – œuvre", "iso-8859-1": "café \u0081", "utf-16": "é漢ਊ字", "utf-32": "漢😀",
         "big5": "中文資料許功蓋", "gb2312": "中文数据", "shift-jis": "日本語表ソ能", "euc-kr": "한국어 자료"}


def write(folder, name, encoding, end="\n"):
    path = os.path.join(folder, name + ".csv")
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(f"id,größe{end}" if encoding not in ("big5", "gb2312", "shift-jis", "euc-kr") else f"id,x{end}")
        for i in range(40):
            f.write(f'{i},"{TEXTS[encoding]}, ""{i}""\nnext"{end}')
    return path


def test_audit_takes_the_first_candidate(spark, tmp_dir):
    for e in TEXTS:
        write(tmp_dir, e, e)
    with open(os.path.join(tmp_dir, "plain.csv"), "w") as f:
        f.write("id,x\n1,2\n")

    def found(*candidates):
        return {os.path.basename(r.path)[:-4]: r.encoding for r in audit_encodings(spark, tmp_dir, candidates).collect()}

    own = found()
    assert {e: own[e] for e in ("utf-8", "cp1252", "iso-8859-1", "utf-16", "utf-32", "plain")} == {
        "utf-8": "utf-8", "cp1252": "cp1252", "iso-8859-1": "iso-8859-1", "utf-16": "utf-16", "utf-32": "utf-32", "plain": "utf-8"}
    for e in ("big5", "gb2312", "shift-jis", "euc-kr"):
        assert found("utf-8", e)[e] == e
        assert found(e)["utf-16"] == "utf-16" and found(e)["plain"] == e
    several = found("ascii", "utf-8", "gb2312", "euc-kr", "big5", "shift-jis")
    for e, got in several.items():
        if e not in ("utf-16", "utf-32"):  # what the first valid candidate in order is, by decoding whole files
            raw = open(os.path.join(tmp_dir, e + ".csv"), "rb").read()
            for c in ("ascii", "utf-8", "gb2312", "euc-kr", "big5", "shift-jis", "cp1252", "iso-8859-1"):
                try:
                    raw.decode(c)
                    break
                except UnicodeDecodeError:
                    pass
            assert got == c, e
    with pytest.raises(ValueError):
        audit_encodings(spark, tmp_dir, ["utf-16le"])


def test_any_encoding_is_read_without_a_session_switch(spark, tmp_dir):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for e in TEXTS:
            path = write(tmp_dir, "f-" + e, e, "\r\n" if e == "big5" else "\n")
            df = read_csv(spark, path, encoding=e, multiline=True)
            got = df.orderBy("row_id").collect()
            assert [tuple(r) for r in got] == [(i, str(i), f'{TEXTS[e]}, "{i}"\nnext') for i in range(40)]
            assert df.columns[2] == ("x" if e in ("big5", "gb2312", "shift-jis", "euc-kr") else "größe")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_a_folder_of_mixed_encodings(spark, tmp_dir):
    order = ("cp1252", "utf-16", "utf-8", "iso-8859-1", "utf-32")
    for i, e in enumerate(order):
        write(tmp_dir, f"{i}", e)
    df = read_csv(spark, tmp_dir, encoding="auto")
    got = [tuple(r) for r in df.orderBy("row_id").collect()]
    assert got == [(40 * n + i, str(i), f'{TEXTS[e]}, "{i}"\nnext')
                   for n, e in enumerate(order) for i in range(40)]
    assert df.columns == ["row_id", "id", "größe"]
    assert sorted((r.n_rows, r.n_dropped) for r in dropped_rows(spark, tmp_dir, encoding="auto").collect()) == [(40, 0)] * 5
    with open(os.path.join(tmp_dir, "5.csv"), "w", encoding="utf-16") as f:
        f.write("id,other\n1,2\n")
    with pytest.raises(Exception, match="headers differ"):
        read_csv(spark, tmp_dir, encoding="auto", row_id=None).collect()


def test_unknown_bytes_are_dropped(spark, tmp_dir):
    path = os.path.join(tmp_dir, "x.csv")
    with open(path, "wb") as f:
        f.write(b"a,b\n1,x\xffy\n2,\x82\n")
    assert [tuple(r) for r in read_csv(spark, path, encoding="shift-jis", row_id=None).collect()] == [("1", "xy"), ("2", "")]
    with pytest.raises(DataTypeError):
        read_csv(spark, path, encoding="no-such-code")
