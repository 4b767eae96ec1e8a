"""Read delimited text as all-string DataFrames.

Spark owns splitting and decoding; the engine owns typing, so no schema is
inferred: every column is STRING.  Header names are repaired the way a pandas
reader names them (duplicates get ``.1``, ``.2``; blanks become
``Unnamed: i``); a headerless file gets ``Column_1..n``.  Rows with too many
fields are dropped (``dropped_rows`` counts them), rows with too few are padded with nulls.
``row_id`` is file order: files by path, then splits by offset, then lines.
"""

from __future__ import annotations

import csv
import io
import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.sources.encoding import audit_encodings
from colsense.sources.records import in_file_order, read_records

CORRUPT = "_corrupt_record"
# what Spark's CSV reader decodes line by line; other encodings go by ``read_records``
_BY_LINE = {"utf-8", "us-ascii", "iso-8859-1"}
# a code unit may hold the byte of a line break: one task a file
_WIDE = {"utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be"}


class DataTypeError(Exception):
    """The data set as a whole can't be read; ``details`` says why."""

    def __init__(self, message: str, details: dict | None = None):
        self.details = dict(details) if details else {}
        Exception.__init__(self, message)


def header_names(tokens: list[str]) -> list[str]:
    """Blank -> 'Unnamed: i'; duplicates -> name.1, name.2 ... (never colliding)."""
    names = [t if t.strip() != "" else f"Unnamed: {i}" for i, t in enumerate(tokens)]
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        candidate = name
        while n > 0:
            seen[name] = n + 1
            candidate = f"{name}.{n}"
            n = seen.get(candidate, 0)
        seen[candidate] = n + 1
        out.append(candidate)
    return out


def _check_path(path: str) -> None:
    """Only .csv files (a folder is read as its .csv files)."""
    if os.path.splitext(path.rstrip("/"))[1].lower() not in ("", ".csv"):
        raise DataTypeError(f"not a .csv path: {path}", {"error": "only .csv files, or a folder of them, are read"})


def _header_tokens(spark: SparkSession, file: str, encoding: str, sep: str, multiline: bool) -> list[str]:
    """Fields of the first record of ``file``; nothing else is read.  With
    ``multiline`` the record may go over several lines."""
    if multiline or encoding != "utf-8":
        # bytes as characters, unless they come in wider units: Spark knows few encodings
        known = encoding if encoding in _WIDE | {"utf-8"} else "iso-8859-1"
        got = spark.read.options(**dialect(sep)).option("multiLine", "true").option("encoding", known).csv(unquote(file)).limit(1).collect()
        tokens = [x or "" for x in got[0]] if got else []
        if known != encoding and encoding != "iso-8859-1":
            tokens = [t.encode("iso-8859-1").decode(encoding, "replace") for t in tokens]
    else:
        got = (spark.read.option("lineSep", "\n").text(unquote(file)).where(F.col("_metadata.file_block_start") == 0)
               .select("value").limit(1).collect())
        line = got[0]["value"].lstrip("\ufeff").rstrip("\r") if got else ""
        tokens = next(csv.reader(io.StringIO(line), delimiter=sep), [])
    if not tokens:
        raise DataTypeError(f"no line in {file}", {"error": "empty input"})
    return tokens


def with_file_order_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Contiguous ids in file order.  One small table row per split (path,
    offset): its row count and first local id; offsets follow path/offset
    order.  Spark broadcasts them if they are small.  The counts come from
    a scan of their own: a split that they don't know raises."""
    cols = [c for c in df.columns if c != "_metadata"]
    tagged = (df.withColumn("_f", F.col("_metadata.file_path"))
                .withColumn("_b", F.col("_metadata.file_block_start"))
                .withColumn("_mid", F.monotonically_increasing_id()))
    splits = tagged.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_f", "_b", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start = F.coalesce(F.col("_off"), F.raise_error(F.lit("the files or their splits changed while rows were numbered")))
    return (tagged.join(offsets, ["_f", "_b"], "left")
                  .select((start + F.col("_mid") - F.col("_first")).alias(name), *cols))


def read_csv(spark: SparkSession, path: str, has_headers: bool = True, encoding: str | None = None,
             row_id: str | None = "row_id", sep: str = ",", drop_long_rows: bool = True,
             multiline: bool = False) -> DataFrame:
    """All-string read of a CSV file or folder of CSV files.

    Read failures surface as DataTypeError with Spark's error as the cause (I5).
    With an explicit ``encoding``, characters the decoder could not map
    (U+FFFD) are dropped, as an 'ignore' decoder would (S6).  Any encoding of
    Python's will do; ``auto`` takes for each file what ``audit_encodings`` finds,
    and all files are one job.  No setting of the session is changed.

    Names come from the first file.  A file whose header has other names, or
    the same in another order, makes the job fail when it is read.  Headers
    with blank or repeated names can't be compared by Spark's reader; there the
    first lines are compared by a scan of their own.

    ``multiline`` (implied by ``auto`` and by encodings that Spark doesn't read by
    line) allows line breaks inside quoted fields.  Files are still
    read by many tasks each (see ``records``), at the price of a scan more; only
    UTF-16 and UTF-32 files are one task each."""
    _check_path(path)
    try:
        names, df = _records(spark, path, has_headers, encoding, sep, multiline)
    except DataTypeError:
        raise
    except Exception as e:  # AnalysisException, missing path, bad charset
        raise DataTypeError(f"Spark could not read {path}", {"error": str(e)}) from e
    if drop_long_rows:
        df = df.where(~F.col("_long"))
    if row_id:
        # numbered after the drop: kept rows have consecutive positions
        df = in_file_order(df, row_id) if "place" in df.columns else with_file_order_id(df, row_id)

    def field(i):
        c = F.col(f"_c{i}")
        return F.regexp_replace(c, "\uFFFD", "") if encoding else c

    return df.select(*([row_id] if row_id else []), *[field(i).alias(n) for i, n in enumerate(names)])


def dropped_rows(spark: SparkSession, path: str, has_headers: bool = True, encoding: str | None = None,
                 sep: str = ",", multiline: bool = False) -> DataFrame:
    """(path, n_rows, n_dropped) for each file: its records, and how many of
    them ``read_csv`` drops because they have more fields than the header."""
    _, df = _records(spark, path, has_headers, encoding, sep, multiline)
    return (df.groupBy(F.col("file" if "place" in df.columns else "_metadata.file_path").alias("path"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_long").alias("n_dropped")))


def _records(spark, path, has_headers, encoding, sep, multiline) -> tuple[list[str], DataFrame]:
    """(names, records): fields ``_c0``.., ``_long`` (more fields than names) and
    ``_metadata``, or the place columns of ``read_records``."""
    enc = (encoding or "utf-8").lower()
    known = {r["path"]: r["encoding"] for r in audit_encodings(spark, path).collect()} if enc == "auto" else {}
    files = known or spark.read.text(path).inputFiles()
    if not files:
        raise DataTypeError(f"no file in {path}", {"error": "empty input"})
    first = min(files)
    tokens = _header_tokens(spark, first, known.get(first, enc), sep, multiline or enc == "auto")
    names = header_names(tokens) if has_headers else [f"Column_{i + 1}" for i in range(len(tokens))]
    width = len(names)
    if enc == "auto" or enc not in _WIDE and (multiline or enc not in _BY_LINE):
        header = tokens if has_headers else None
        wide = {f: e for f, e in known.items() if e in _WIDE}
        parts = [_wide_records(spark, [f for f in wide if wide[f] == e], header, width, e, sep) for e in sorted(set(wide.values()))]
        if len(wide) < len(files):
            rest = [unquote(f) for f in files if f not in wide] if wide else path
            parts.append(_split_records(spark, rest, header, width, known or enc, sep))
        return names, reduce(DataFrame.unionByName, parts)
    plain = {t.lower() for t in tokens} - {"", CORRUPT, "_metadata"}
    comparable = has_headers and len(plain) == width and names == tokens
    if has_headers and not comparable:
        _compare_first_lines(spark, path, encoding)
    fields = tokens if comparable else [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*fields, CORRUPT]])
    reader = (spark.read.schema(schema).option("header", str(has_headers).lower())
              .option("enforceSchema", str(not comparable).lower()).options(**dialect(sep)))
    if encoding:
        reader = reader.option("encoding", encoding)
    if enc in _WIDE:
        reader = reader.option("multiLine", "true")
    cells = [F.col("`" + n.replace("`", "``") + "`") for n in fields]
    # The second term (never false) makes every use of this flag read all data
    # columns: Spark refuses a scan of the corrupt-record column alone, and
    # with fewer columns its parser flags different lines.
    reads_data = F.length(F.concat_ws("\u0001", *cells)) >= 0
    long = has_more_fields(F.col(CORRUPT), width, sep) & reads_data
    return names, reader.csv(path).select(*(c.alias(f"_c{i}") for i, c in enumerate(cells)),
                                          F.coalesce(long, F.lit(False)).alias("_long"), "_metadata")


def dialect(sep: str = ",") -> dict[str, str]:
    """Options of Spark's CSV readers: what a record is, here and in streams."""
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def has_more_fields(bad: Column, width: int, sep: str) -> Column:
    """Spark flags short and long records alike; a flagged one is long when it
    has more fields than the header (quoted fields blanked first)."""
    found = F.size(F.split(F.regexp_replace(bad, r'"[^"]*+(?:""[^"]*+)*+"', ""), re.escape(sep), -1))
    return bad.isNotNull() & (found > width)


def _split_records(spark: SparkSession, path: str | list[str], header: list[str] | None, width: int,
                   encoding: str | dict[str, str], sep: str) -> DataFrame:
    """Records over several lines, parsed; the first record of each file must be ``header`` and goes."""
    schema = ", ".join(f"{c} string" for c in [*(f"_c{i}" for i in range(width)), CORRUPT])
    parsed = F.from_csv("text", F.lit(schema), dialect(sep) | {"multiLine": "true"})
    # as a generated row: Spark would parse a record again for each field it takes of it
    rows = read_records(spark, path, sep, encoding).select("file", "start", "place", "whole", F.explode(F.array(parsed)).alias("r"))
    return _without_headers(rows.select("file", "start", "place", "whole", "r.*"), header, width, sep)


def _wide_records(spark: SparkSession, files: list[str], header: list[str] | None, width: int, encoding: str, sep: str) -> DataFrame:
    """The same of files in which a line break is no single byte: one task a file."""
    schema = ", ".join(f"{c} string" for c in [*(f"_c{i}" for i in range(width)), CORRUPT])
    rows = (spark.read.schema(schema).options(**dialect(sep)).option("multiLine", "true").option("encoding", encoding)
            .csv([unquote(f) for f in files])
            .select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"),
                    F.monotonically_increasing_id().alias("place"), F.lit(True).alias("whole"), "*"))
    first = rows.groupBy("file").agg(F.min("place").alias("first"))  # a row a file
    rows = rows.join(first, "file").withColumn("place", F.col("place") - F.col("first")).drop("first")
    return _without_headers(rows, header, width, sep)


def _without_headers(rows: DataFrame, header: list[str] | None, width: int, sep: str) -> DataFrame:
    fields = [f"_c{i}" for i in range(width)]
    if header is not None:
        cells = F.array(*(F.coalesce(c, F.lit("")) for c in fields))
        same = F.col(CORRUPT).isNull() & (cells == F.array(*(F.lit(t) for t in header)))
        differ = F.raise_error(F.concat(F.lit("headers differ: "), F.col("file"))).cast("boolean")
        first = (F.col("start") == 0) & (F.col("place") == 0)
        rows = rows.where(F.when(first, ~F.when(same, True).otherwise(differ)).otherwise(True))
    long = F.coalesce(has_more_fields(F.col(CORRUPT), width, sep), F.lit(False))
    # all columns are read, so that Spark's parser flags the same records whatever is selected
    reads_data = F.length(F.concat_ws("\u0001", *fields)) >= 0
    return rows.select("file", "start", "place", "whole", *fields, (long & reads_data).alias("_long"))


def _compare_first_lines(spark: SparkSession, path: str, encoding: str | None) -> None:
    """Raise unless all files have the same first line."""
    reader = spark.read.option("encoding", encoding) if encoding else spark.read
    heads = (reader.option("lineSep", "\n").text(path).where(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
                     F.regexp_replace("value", "\r$", "").alias("line"))
             .groupBy("file").agg(F.min_by("line", "at").alias("head")))
    if heads.select("head").distinct().limit(2).count() > 1:
        raise DataTypeError(f"headers differ in {path}", {"error": "files of one folder need one header"})


def write_csv(df: DataFrame, path: str, header: bool = True, encoding: str | None = None,
              partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", str(header).lower()).option("quote", '"').option("escape", '"')
    w = w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    if encoding:
        w = w.option("encoding", encoding)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
