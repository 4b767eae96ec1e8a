"""Free-form date/time text -> TIMESTAMP_NTZ over a closed format list.

Each entry is (shape regex, Spark pattern, zoned).  The shape is a cheap guard
so the parser only sees plausible text; ``coalesce`` stops at the first hit,
so order decides ambiguous values (month-first before day-first).  Parsing
does not depend on the session time zone: unzoned text is read as UTC wall
clock, zoned text is converted to UTC and stored zone-less.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.text import as_col, let, py_strip

_D = r"[0-9]{1,2}"
_Y4 = r"[0-9]{4}"
_TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?"
_ZONE = r"(?:Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)"
_MON = r"[A-Za-z]{3,9}\.?"
_T = "H:mm[:ss[.SSSSSS]]"

DATETIME_FORMATS = [
    (rf"^{_Y4}-{_D}-{_D}$", "yyyy-M-d", False),
    (rf"^{_Y4}-{_D}-{_D} {_TIME}$", f"yyyy-M-d {_T}", False),
    (rf"^{_Y4}-{_D}-{_D}T{_TIME}$", f"yyyy-M-d'T'{_T}", False),
    (rf"^{_Y4}-{_D}-{_D}[T ]{_TIME}{_ZONE}$", f"yyyy-M-d'T'{_T}XXX", True),
    (rf"^{_Y4}-{_D}-{_D}[T ]{_TIME}{_ZONE}$", f"yyyy-M-d'T'{_T}X", True),
    (rf"^{_Y4}-{_D}-{_D}[T ]{_TIME}{_ZONE}$", f"yyyy-M-d {_T}XXX", True),
    (rf"^{_Y4}-{_D}-{_D}[T ]{_TIME}{_ZONE}$", f"yyyy-M-d {_T}X", True),
    (rf"^{_Y4}-{_D}-{_D} {_D}:[0-9]{{2}}(?::[0-9]{{2}})? [AaPp][Mm]$", "yyyy-M-d h:mm[:ss] a", False),
    (rf"^{_Y4}/{_D}/{_D}$", "yyyy/M/d", False),
    (rf"^{_Y4}/{_D}/{_D} {_TIME}$", f"yyyy/M/d {_T}", False),
    (rf"^{_Y4}-{_D}$", "yyyy-M", False),
    (rf"^{_D}/{_D}/{_Y4}$", "M/d/yyyy", False),
    (rf"^{_D}/{_D}/{_Y4}$", "d/M/yyyy", False),
    (rf"^{_D}/{_D}/{_Y4} {_TIME}$", f"M/d/yyyy {_T}", False),
    (rf"^{_D}/{_D}/{_Y4} {_TIME}$", f"d/M/yyyy {_T}", False),
    (rf"^{_D}/{_D}/[0-9]{{2}}$", "M/d/yy", False),
    (rf"^{_D}/{_D}/[0-9]{{2}}$", "d/M/yy", False),
    (rf"^{_D}-{_D}-{_Y4}$", "M-d-yyyy", False),
    (rf"^{_D}-{_D}-{_Y4}$", "d-M-yyyy", False),
    (rf"^{_D} {_MON} {_Y4}$", "d MMM yyyy", False),
    (rf"^{_D} {_MON} {_Y4}$", "d MMMM yyyy", False),
    (rf"^{_MON} {_D}, {_Y4}$", "MMM d, yyyy", False),
    (rf"^{_MON} {_D}, {_Y4}$", "MMMM d, yyyy", False),
    (rf"^{_MON} {_D} {_Y4}$", "MMM d yyyy", False),
    (rf"^{_MON} {_D} {_Y4}$", "MMMM d yyyy", False),
    (rf"^{_D} {_MON} {_Y4} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} [+-][0-9]{{4}}$", "d MMM yyyy HH:mm:ss X", True),
    (r"^[0-9]{8}$", "yyyyMMdd", False),
    (r"^[0-9]{8}T[0-9]{6}$", "yyyyMMdd'T'HHmmss", False),
    (rf"^{_D}/{_D}/{_Y4} {_D}:[0-9]{{2}} [AaPp][Mm]$", "M/d/yyyy h:mm a", False),
    (rf"^{_D}/{_D}/{_Y4} {_D}:[0-9]{{2}} [AaPp][Mm]$", "d/M/yyyy h:mm a", False),
    (rf"^{_D}-{_MON}-{_Y4}$", "d-MMM-yyyy", False),
    (rf"^{_MON} {_Y4}$", "MMM yyyy", False),
    (rf"^{_MON} {_Y4}$", "MMMM yyyy", False),
    (rf"^{_MON} {_D}, {_Y4} {_D}:[0-9]{{2}} [AaPp][Mm]$", "MMM d, yyyy h:mm a", False),
    (rf"^{_MON} {_D}, {_Y4} {_D}:[0-9]{{2}} [AaPp][Mm]$", "MMMM d, yyyy h:mm a", False),
]

# Every shape of the list has four digits in a row, or a year of two after a slash.
_SOME_YEAR = r"[0-9]{4}|/[0-9]{2}"
_WEEKDAY = r"^[A-Za-z]{3}, "
_LONG_FRACTION = r"(\.[0-9]{6})[0-9]+"


def parse_ntz(s: Column, pattern: str, zoned: bool) -> Column:
    """One pattern -> TIMESTAMP_NTZ, independent of the session zone."""
    if zoned:
        ts = F.try_to_timestamp(s, F.lit(pattern))
    else:
        ts = F.try_to_timestamp(F.concat(s, F.lit(" Z")), F.lit(pattern + " X"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


def to_datetime(c, formats=None) -> Column:
    """First format in ``formats`` whose shape and pattern both accept the value.

    With the default list, text already in one of its first two shapes (ISO
    date, ISO date and time without zone) is parsed directly - the same
    patterns the list tries first, in whole-stage generated code."""
    if formats is None:
        c = as_col(c)
        (d_shape, d_pat, _), (t_shape, t_pat, _) = DATETIME_FORMATS[0], DATETIME_FORMATS[1]
        return (F.when(c.rlike(d_shape), parse_ntz(c, d_pat, False))
                .when(c.rlike(t_shape), parse_ntz(c, t_pat, False))
                .when(c.rlike(_SOME_YEAR), _to_datetime(c, DATETIME_FORMATS)))
    return _to_datetime(c, formats)


def _to_datetime(c, formats) -> Column:
    prepared = F.regexp_replace(F.regexp_replace(py_strip(as_col(c)), _WEEKDAY, ""),
                                _LONG_FRACTION, "$1")
    # one combined guard first: text that fits no shape costs a single regex
    any_shape = "|".join("(?:" + shape + ")" for shape in dict.fromkeys(f[0] for f in formats))
    return let(prepared, lambda s: F.when(
        s.rlike(any_shape),
        F.coalesce(*[F.when(s.rlike(shape), _century(parse_ntz(s, pat, zoned), pat))
                     for shape, pat, zoned in formats])))


def _century(ts: Column, pattern: str) -> Column:
    """Two-digit years 69-99 are of the 20th century, 00-68 of the 21st."""
    if "yy" not in pattern or "yyyy" in pattern:
        return ts
    return F.when(F.year(ts) >= 2069, ts - F.make_ym_interval(F.lit(100), F.lit(0))).otherwise(ts)
