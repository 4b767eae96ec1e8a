"""CSV records that may go over several lines, read by many tasks a file.

Whether a line break ends a record depends on all quotes before it, so a split
can't tell alone where its first record starts.  But a line is only entered in
two ways, at the start of a record or inside a quoted field, and what it makes
of each is found from the line alone.  One scan composes these small functions
over each split, ``split_states`` composes them over the splits of a file, and
with the way every split is entered a second scan puts whole records together.
Only a record that crosses splits is put together by a shuffle of its parts.

The rules are those of Spark's CSV parser with ``"`` as quote and as escape: a
field is quoted if its first character is a quote, two quotes in it are one, and
text after the closing quote makes the rest up to the separator plain.  Records
end with a line feed, or a carriage return and a line feed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
# where a line is, after a quote or the text that follows one
_PLAIN, _FIELD_START, _QUOTED, _QUOTE_SEEN = range(4)


def ends_quoted(line: Column, sep: str, entered_quoted: bool) -> Column:
    """Whether a quoted field is open at the end of ``line``."""
    def after_text(state, text):
        plain = F.when(F.endswith(text, F.lit(sep)), _FIELD_START).otherwise(_PLAIN)
        return F.when((text == "") | (state == _QUOTED), state).otherwise(plain)

    def after_quote(state):
        return (F.when(state == _FIELD_START, _QUOTED).when(state == _QUOTED, _QUOTE_SEEN)
                .when(state == _QUOTE_SEEN, _QUOTED).otherwise(state))

    parts = F.split(line, QUOTE, -1)
    first = after_text(F.lit(_QUOTED if entered_quoted else _FIELD_START), F.element_at(parts, 1))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.aggregate(rest, first.cast("int"), lambda s, text: after_text(after_quote(s), text).cast("int"))
    return F.when(F.contains(line, F.lit(QUOTE)), last == _QUOTED).otherwise(F.lit(entered_quoted))


def _lines(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    raw = F.col("value").cast("binary")
    # one character a byte: quotes and separators are found whatever the other bytes mean
    line = F.when(F.contains(raw, F.lit(QUOTE).cast("binary")), F.decode(raw, "ISO-8859-1")).otherwise("")
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    ends_quoted(line, sep, False).alias("from_start"), ends_quoted(line, sep, True).alias("from_quoted"),
                    raw.alias("text")))


def split_states(lines: DataFrame) -> dict[str, tuple[list[int], list[bool]]]:
    """For each file the offsets of its splits and whether each is entered inside
    a quoted field.  One row a split comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fresh, quoted, out = None, False, True, []
        for batch in batches:
            for file, start, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, start):
                    if at:
                        out.append((*at, fresh, quoted))
                    at, fresh, quoted = (file, start), False, True
                fresh, quoted = b if fresh else a, b if quoted else a
        if at:
            out.append((*at, fresh, quoted))
        yield pa.RecordBatch.from_pydict(dict(zip(("file", "start", "fresh", "quoted"), map(list, zip(*out)))) if out else
                                         {"file": [], "start": [], "fresh": [], "quoted": []}, schema=pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("fresh", pa.bool_()), ("quoted", pa.bool_())]))

    found = lines.select("file", "start", "from_start", "from_quoted").mapInArrow(
        run, "file string, start long, fresh boolean, quoted boolean")
    states: dict[str, tuple[list[int], list[bool]]] = {}
    now: dict[str, bool] = {}
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["start"])):
        starts, entered = states.setdefault(r["file"], ([], []))
        starts.append(r["start"])
        entered.append(now.get(r["file"], False))
        now[r["file"]] = r["quoted"] if entered[-1] else r["fresh"]
    return states


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",",
                 encoding: str | Mapping[str, str] = "utf-8") -> DataFrame:
    """(file, start, place, whole, text): the records of CSV files, empty lines
    left out.  ``start`` is the offset of the split where a record begins,
    ``place`` its number there from 0 on, and ``whole`` says that it ends there;
    at most the last record of a split does not.  A quote that is never closed takes the rest of its
    file.  A file without lines has no records.

    ``encoding`` is any of Python's in which the bytes of quotes, line breaks and
    ``sep`` mean nothing else, or one for each file; bytes that it does not know
    become U+FFFD.
    """
    lines = _lines(spark, path, sep)
    states = split_states(lines)

    # both functions go to the tasks as they are: they need nothing of this package there
    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("file", "start", "place", "closed", "text")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # begun: a record of this split; else the open lines belong to one before
        at, place, quoted, begun, open_ = None, 0, False, True, []
        out: list[tuple] = []

        def put(closed: bool) -> None:
            nonlocal place, open_
            text, open_ = b"\n".join(open_), []
            if not closed or not begun or text not in (b"", b"\r"):
                known = encoding if isinstance(encoding, str) else encoding[at[0]]
                out.append((*at, place if begun else -1, closed, text.decode(known, "replace")))
                place += begun

        for batch in batches:
            for file, start, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, start):
                    if open_:
                        put(False)
                    at, place = (file, start), 0
                    starts, entered = states.get(file, ([], []))
                    i = bisect_left(starts, start)
                    if i == len(starts) or starts[i] != start:
                        raise ValueError(f"the splits of {file} changed while its records were read")
                    quoted = entered[i]
                    begun = not quoted
                open_.append(text)
                quoted = b if quoted else a
                if not quoted:
                    put(True)
                    begun = True
            if out:
                yield as_batch(out)
                out.clear()
        if open_:
            put(False)
        if out:
            yield as_batch(out)

    parts = lines.mapInArrow(run, "file string, start long, place long, closed boolean, text string")
    whole = parts.where("closed AND place >= 0").select("file", "start", "place", F.lit(True).alias("whole"), "text")
    cut = parts.where("NOT closed OR place < 0")
    # at most two parts of each split: the last that begins in it and what it continues
    order = Window.partitionBy("file").orderBy("start", "place")
    record = F.sum(F.when(F.col("place") >= 0, 1).otherwise(0)).over(order)
    joined = (cut.withColumn("record", record).groupBy("file", "record")
              .agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts"))
              .select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["place"].alias("place"),
                      F.lit(False).alias("whole"), F.array_join("parts.text", "\n").alias("text")))
    return whole.union(joined).withColumn("text", F.regexp_replace("text", "\r\\z", ""))


def in_file_order(records: DataFrame, name: str) -> DataFrame:
    """``records(file, start, place, whole, ...)``, or some of them, numbered 0,
    1, ... in the order of the files.  Records that end in their split are numbered
    as they are scanned, without a shuffle; the one that does not is its last.
    The counts are one row a split."""
    tagged = records.withColumn("_mid", F.monotonically_increasing_id())
    splits = tagged.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.count_if("whole").alias("_whole"),
                                                 F.min(F.when(F.col("whole"), F.col("_mid"))).alias("_first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "_whole", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    off = F.coalesce("_off", F.raise_error(F.lit("the files or their splits changed while rows were numbered")))
    at = F.when(F.col("whole"), F.col("_mid") - F.col("_first")).otherwise(F.col("_whole"))
    rest = [c for c in records.columns if c not in ("file", "start", "place", "whole")]
    return tagged.join(splits, ["file", "start"], "left").select((off + at).cast("long").alias(name), *rest)
