"""Column -> Column cleaners (native Spark expressions)."""

from colsense.functions.boolean import is_bool_token, render_bool, to_bool
from colsense.functions.datetime import DATETIME_FORMATS, to_datetime
from colsense.functions.duration import days_to_interval, duration_days, to_duration
from colsense.functions.labels import type_label
from colsense.functions.missing import (clean_missing, is_missing, is_missing_pattern,
                                        is_missing_token, null_if_missing)
from colsense.functions.numeric import (is_integral, numeric_parts, strict_double, to_bigint,
                                        to_complex, to_double)
from colsense.functions.text import norm, py_strip

__all__ = [
    "DATETIME_FORMATS", "clean_missing", "days_to_interval", "duration_days", "is_bool_token",
    "is_integral", "is_missing", "is_missing_pattern", "is_missing_token", "norm",
    "null_if_missing", "numeric_parts", "py_strip", "render_bool", "strict_double", "to_bigint",
    "to_bool", "to_complex", "to_datetime", "to_double", "to_duration", "type_label",
]
