"""Pages, page counts, JSON previews and the response bundle."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsense.functions.text import named
from colsense.functions import vocab as V
from colsense.functions.boolean import render_bool
from colsense.functions.duration import interval_seconds

Response = namedtuple("Response", ["types", "errors", "preview", "total_rows", "failed"])


def page(df: DataFrame, page_no: int = 1, page_size: int = V.DEFAULT_PAGE_SIZE,
         row_id: str = "row_id") -> DataFrame:
    """L1: rows [(page-1)*size, page*size) by contiguous row id.  A range filter
    (prunes parquet row groups when row_id is stored), not an offset scan."""
    if page_no < 1:
        raise ValueError("page numbers start at 1")
    if page_size < 1:
        raise ValueError("page size must be positive")
    lo = (page_no - 1) * page_size
    return (df.where((F.col(row_id) >= lo) & (F.col(row_id) < lo + page_size))
              .orderBy(row_id))


def page_count(total_rows: Column, page_size: int) -> Column:
    """L2: ceil(total / size)."""
    return F.ceil(total_rows / F.lit(page_size)).cast("long")


def _json_double(c: Column) -> Column:
    return F.round(c, 10)


def _python_number(c: Column) -> Column:
    # integral doubles print without ".0", as Python's complex repr does
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e16), c.cast("long").cast("string")) \
            .otherwise(c.cast("string"))


def render_complex(c: Column) -> Column:
    """'(3+4j)' / '4j' text of a struct(re, im)."""
    re_, im = c["re"], c["im"]
    sign = F.when(im < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.when(c.isNotNull(), F.when(re_ == 0, F.concat(_python_number(im), F.lit("j")))
                  .otherwise(F.concat(F.lit("("), _python_number(re_), sign,
                                      _python_number(F.abs(im)), F.lit("j)"))))


def render_duration(c: Column) -> Column:
    """ISO 8601 'P2DT12H0M0S' text of a DAY TO SECOND interval."""
    total = interval_seconds(c)
    a = F.abs(total)
    days = F.floor(a / 86400)
    rest = a - days * 86400
    hours = F.floor(rest / 3600)
    minutes = F.floor((rest - hours * 3600) / 60)
    secs = rest - hours * 3600 - minutes * 60
    sec_text = F.regexp_replace(F.format_string("%.6f", secs), r"\.?0+$", "")
    return F.when(c.isNotNull(), F.concat(
        F.when(total < 0, F.lit("-")).otherwise(F.lit("")), F.lit("P"), days.cast("long").cast("string"),
        F.lit("DT"), hours.cast("long").cast("string"), F.lit("H"), minutes.cast("long").cast("string"),
        F.lit("M"), sec_text, F.lit("S")))


def json_ready(df: DataFrame) -> DataFrame:
    """Columns rendered as the preview shows them."""
    out = []
    for f in df.schema.fields:
        c, t = named(f.name), f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        elif isinstance(t, T.DayTimeIntervalType):
            c = render_duration(c)
        elif isinstance(t, T.StructType) and [x.name for x in t.fields] == ["re", "im"]:
            c = render_complex(c)
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = _json_double(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def preview_json(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """L4: (row_id, one JSON record per row), nulls kept."""
    ready = json_ready(df)
    body = [c for c in ready.columns if c != row_id]
    return ready.select(row_id, F.to_json(F.struct(*map(named, body)), {"ignoreNullFields": "false"}).alias("json"))


def preview_bool(df: DataFrame) -> DataFrame:
    """B2 at the preview sink: boolean columns as 'True' / 'False' text."""
    return df.select(*[render_bool(named(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.BooleanType) else named(f.name)
                       for f in df.schema.fields])


def response(types: DataFrame, errors: DataFrame, data: DataFrame, page_no: int = 1,
             page_size: int = V.DEFAULT_PAGE_SIZE, row_id: str = "row_id") -> Response:
    """What the upload endpoint returned, as DataFrames plus two numbers."""
    total = data.count()
    return Response(types, errors, preview_json(page(preview_bool(data), page_no, page_size, row_id), row_id),
                    total, not errors.isEmpty())
