"""M1-M3: spellings of "missing" become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.functions.text import as_col, named, ws
from colsense.functions.vocab import ALL_MISSING_TOKENS, MISSING_PATTERNS

# One case-insensitive alternation; (?d) makes "$" honour only "\n" as a line
# end, as Python's re does.
MISSING_REGEX = "(?iUd)" + "|".join(ws(p) for p in MISSING_PATTERNS)


def is_missing_token(c) -> Column:
    """M1: exact, case-sensitive, untrimmed match."""
    return as_col(c).isin(ALL_MISSING_TOKENS)


def is_missing_pattern(c) -> Column:
    """M2: whole-value patterns, case-insensitive."""
    return as_col(c).rlike(MISSING_REGEX)


def is_missing(c) -> Column:
    c = as_col(c)
    return c.isNull() | is_missing_token(c) | is_missing_pattern(c)


def null_if_missing(c) -> Column:
    c = as_col(c)
    return F.when(~(is_missing_token(c) | is_missing_pattern(c)), c)


def clean_missing(df: DataFrame, cols=None) -> DataFrame:
    """M3: null out missing spellings in ``cols`` (default: all string columns)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    wanted = set(cols)
    return df.select(*[null_if_missing(named(n)).alias(n) if n in wanted else named(n)
                       for n in df.columns])
