"""V1: display label of a logical type name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.text import as_col
from colsense.functions.vocab import TYPE_LABELS


def type_label(c) -> Column:
    c = as_col(c)
    m = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)
