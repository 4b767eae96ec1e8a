"""B1/B2: boolean spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.text import as_col, norm
from colsense.functions.vocab import BOOLEAN_VALUES, FALSE_KEYS, TRUE_KEYS


def is_bool_token(c) -> Column:
    return norm(c).isin(list(BOOLEAN_VALUES))


def to_bool(c) -> Column:
    """B1: trimmed, lower-cased lookup; anything else is null."""
    n = norm(c)
    return F.when(n.isin(TRUE_KEYS), F.lit(True)).when(n.isin(FALSE_KEYS), F.lit(False))


def render_bool(c) -> Column:
    """B2: 'True' / 'False' text, null stays null."""
    c = as_col(c)
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))
