"""Small text helpers shared by the cleaners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.vocab import PY_WHITESPACE, WS_CLASS


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Trim every character Python's ``str.strip()`` would trim."""
    return F.btrim(as_col(c), F.lit(PY_WHITESPACE))


def norm(c) -> Column:
    """``str(x).strip().lower()``."""
    return F.lower(py_strip(c))


def ws(pattern: str) -> str:
    r"""Rewrite ``\s`` in a Python pattern to the Java class of Python blanks."""
    return pattern.replace(r"\s", WS_CLASS)


# A plain decimal number as Python's float() accepts it (no inf/nan, no
# underscores), optionally surrounded by blanks.
FLOAT_BODY = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
FLOAT_GUARD = "(?Ui)^" + WS_CLASS + "*" + FLOAT_BODY + WS_CLASS + "*$"


_FLOAT_CAPTURE = "(?Ui)^" + WS_CLASS + "*(" + FLOAT_BODY + ")" + WS_CLASS + "*$"


def guarded_double(c) -> Column:
    """float(x) or null.  Only text of Python's float grammar reaches the
    cast, which keeps out what Java accepts and Python does not (``5d``,
    ``5f``, ``0x1p3``), and spares other text a cast that fails: each would
    throw and catch an exception."""
    c = as_col(c)
    return F.when(c.rlike(FLOAT_GUARD), F.regexp_extract(c, _FLOAT_CAPTURE, 1).try_cast("double"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column
    function) that may use it many times.  Without the binding, every use
    would copy the whole expression tree of ``value``."""
    return F.transform(F.array(value), body).getItem(0)


_MEMO: dict = {}


def memo_column(build, *key) -> Column:
    """Build a Column once per Spark application and key.  Large cleaner
    expressions take thousands of driver-to-JVM calls to assemble; a Column
    is immutable, so one built expression is reused by every query."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    full = (sc.applicationId if sc is not None else None,) + key
    hit = _MEMO.get(full)
    if hit is None:
        hit = _MEMO[full] = build()
    return hit


def frozen(mapping) -> tuple:
    return tuple(sorted((mapping or {}).items()))


def named(name: str) -> Column:
    """The top-level column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
