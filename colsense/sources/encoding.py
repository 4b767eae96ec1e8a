"""Choose an encoding per file, as a Spark job over a folder.

A byte-order mark decides; else the first candidate that decodes the whole file
strictly, the caller's candidates first, then utf-8, cp1252 and iso-8859-1 (which
accepts every byte string).  Lines are read as raw bytes by the text source, so
large files are checked by many tasks.  That is exact: in none of the candidates
is the byte of a line feed part of another character, so a file is valid if its
lines are.  UTF-16 and UTF-32, where this does not hold, are found by their marks
alone.  A UTF-8 mark is removed by the line reader before Spark sees the line, so
such a file reports utf-8, the setting that reads it correctly.

utf-8, ascii, cp1252 and iso-8859-1 are checked by native expressions.  Only for
other candidates do lines with bytes over 127 go through Python's decoders.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# bytes with no character in cp1252
_CP1252_HOLES = "[\u0081\u008d\u008f\u0090\u009d]"
_LAST = ("utf-8", "cp1252", "iso-8859-1")
_MARKS = (("FFFE0000", "utf-32"), ("0000FEFF", "utf-32"), ("FFFE", "utf-16"), ("FEFF", "utf-16"))


def _undecodable(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """(path, bad): for each file the ``names`` that do not decode one of its lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good: dict[str, list[str]] = {}
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist()):
                left = good.setdefault(path, list(names))
                for name in tuple(left):
                    try:
                        value.decode(name)
                    except UnicodeDecodeError:
                        left.remove(name)
        rows = [(p, n) for p, left in good.items() for n in names if n not in left]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "name"])

    found = lines.where("high").select("path", "raw").mapInArrow(run, "path string, name string")
    return found.groupBy("path").agg(F.collect_set("name").alias("bad"))


def audit_encodings(spark: SparkSession, path: str | list[str], candidates: Sequence[str] = ()) -> DataFrame:
    """(path, encoding, n_lines) for each file with a line.  ``candidates`` are
    encodings of Python's in which a byte below 64 stands for itself wherever it
    is (big5, gb2312, shift-jis, euc-kr and all single-byte ones)."""
    candidates = tuple(dict.fromkeys([*(c.lower() for c in candidates), *_LAST]))
    for c in candidates:
        if codecs.lookup(c).name.startswith(("utf-16", "utf-32", "utf-7")):
            raise ValueError(f"{c} is found by its byte-order mark only")
    raw = F.col("value").cast("binary")
    latin = F.decode(raw, "ISO-8859-1")
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_mid"), raw.alias("raw"), F.col("value"),
                     latin.rlike("[\u0080-\u00ff]").alias("high"), latin.rlike(_CP1252_HOLES).alias("holes")))
    native = {"utf-8": F.bool_and(F.is_valid_utf8("value")), "ascii": ~F.bool_or("high"), "cp1252": ~F.bool_or("holes"),
              "iso-8859-1": F.bool_and(F.lit(True))}
    others = [c for c in candidates if c not in native]
    files = lines.groupBy("path").agg(
        F.struct(*(agg.alias(c) for c, agg in native.items())).alias("valid"),
        F.min_by(F.hex(F.substr("raw", F.lit(1), F.lit(4))), F.when(F.col("_b") == 0, F.col("_mid"))).alias("head"),
        F.count(F.lit(1)).alias("n_lines"))
    files = files.join(_undecodable(lines, others), "path", "left") if others else files.withColumn("bad", F.array())
    bad, head = F.coalesce("bad", F.array().cast("array<string>")), F.coalesce("head", F.lit(""))
    marked = [F.when(head.startswith(m), F.lit(c)) for m, c in _MARKS]
    tried = [F.when(F.col("valid")[c] if c in native else ~F.array_contains(bad, c), F.lit(c)) for c in candidates]
    return files.select("path", F.coalesce(*marked, *tried).alias("encoding"), "n_lines")
