"""Per-column type overrides.

An override is applied to the *raw* value, before missing spellings are
nulled.  Values a CSV reader would already have read as missing (the reader
null spellings) count as null here, as they never reached the override.
Coercing overrides (Int64, float64, timedelta64[ns]) never fail; the others
are all-or-nothing: one value that cannot be converted fails the column, an
error row is written and the column is inferred as if no override was given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions import vocab as V
from colsense.functions.boolean import is_bool_token, to_bool
from colsense.functions.datetime import to_datetime
from colsense.functions.duration import to_duration
from colsense.functions.numeric import complex_parts, is_integral, strict_double
from colsense.functions.text import as_col, py_strip

_INT_WIDTHS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64,
               "Int8": 8, "Int16": 16, "Int32": 32}
_INT_SPARK = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
_TEXT_TYPES = {V.CATEGORY, V.OBJECT, V.STRING, "str"}
_STRICT_INT = r"^\s*[+-]?[0-9]+\s*$"
_REAL_ONLY = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan)$"
_BRACKETED = r"(?s)^\((.*)\)$"

SUPPORTED_OVERRIDES = ([V.INT, V.FLOAT, V.COMPLEX, V.DURATION, V.DATETIME, V.BOOL, "float32"]
                       + sorted(_TEXT_TYPES) + list(_INT_WIDTHS))


def is_supported(type_name: str) -> bool:
    return type_name in SUPPORTED_OVERRIDES


def raw_value(c) -> Column:
    """The raw value with reader null spellings as null."""
    c = as_col(c)
    return F.when(~c.isin(V.READER_NULL_TOKENS), c)


def _override_complex(r: Column) -> Column:
    """struct(ok, re, im): complex() of the value with i -> j (case-sensitive)."""
    z = F.lower(py_strip(F.replace(r, F.lit("i"), F.lit("j"))))
    # complex() accepts one pair of brackets around any of its forms
    body = F.when(z.rlike(_BRACKETED), py_strip(F.regexp_extract(z, _BRACKETED, 1))).otherwise(z)
    real_ok = body.rlike(_REAL_ONLY)
    cp = complex_parts(z)
    real = F.when(body == "nan", F.lit(float("nan"))).otherwise(body.try_cast("double"))
    ok = real_ok | cp["ok"]
    return F.struct(ok.alias("ok"),
                    F.when(real_ok, real).otherwise(cp["re"]).alias("re"),
                    F.when(real_ok, F.lit(0.0)).otherwise(cp["im"]).alias("im"))


def _strict_int(r: Column, width: int) -> Column:
    lo, hi = -(2 ** (width - 1)), 2 ** (width - 1) - 1
    v = F.when(r.rlike("(?U)" + _STRICT_INT.replace(r"\s", r"[\s\x{1c}-\x{1f}]")),
               py_strip(r).try_cast("decimal(38,0)"))
    return F.when((v >= lo) & (v <= hi), v.cast(_INT_SPARK[width]))


def _exact_int(r: Column) -> Column:
    """BIGINT of a number: integer text keeps all its digits."""
    d = strict_double(r)
    whole = F.when(r.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(r).try_cast("bigint"))
    return F.coalesce(whole, F.when(is_integral(d), d.cast("bigint")))


def override_value(c, type_name: str) -> Column:
    """Converted value under a successful override."""
    r = raw_value(c)
    if type_name == V.FLOAT:
        return strict_double(r)
    if type_name == V.INT:
        return _exact_int(r)
    if type_name == "float32":
        return strict_double(r).cast("float")
    if type_name in _INT_WIDTHS:
        return _strict_int(r, _INT_WIDTHS[type_name])
    if type_name == V.COMPLEX:
        z = _override_complex(r)
        return F.when(z["ok"], F.struct(z["re"].alias("re"), z["im"].alias("im")))
    if type_name == V.DURATION:
        return to_duration(r)
    if type_name == V.DATETIME:
        return to_datetime(r)
    if type_name == V.BOOL:
        return to_bool(r)
    if type_name in _TEXT_TYPES:
        return r
    raise ValueError(f"data type '{type_name}' not understood")


def override_fails(c, type_name: str) -> Column:
    """True where a non-null raw value cannot take the requested type."""
    r = raw_value(c)
    present = r.isNotNull()
    if type_name == V.INT:  # a number that is no 64-bit integer; text that is no number is null, as for float64
        return present & strict_double(r).isNotNull() & _exact_int(r).isNull()
    if type_name in (V.FLOAT, V.DURATION) or type_name in _TEXT_TYPES:
        return F.lit(False)
    if type_name == "float32":
        return present & strict_double(r).isNull()
    if type_name in _INT_WIDTHS:
        return present & _strict_int(r, _INT_WIDTHS[type_name]).isNull()
    if type_name == V.COMPLEX:
        return present & ~_override_complex(r)["ok"]
    if type_name == V.DATETIME:
        return present & to_datetime(r).isNull()
    if type_name == V.BOOL:
        return present & ~is_bool_token(r)
    return present | F.lit(True)


def failure_text(type_name: str, n_failed: Column) -> Column:
    if not is_supported(type_name):
        return F.lit(f"data type '{type_name}' not understood")
    return F.concat(F.lit("could not convert "), n_failed.cast("string"),
                    F.lit(f" value(s) to {type_name}"))

