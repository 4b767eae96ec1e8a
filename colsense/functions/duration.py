"""A count of days -> DAY TO SECOND interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.text import guarded_double, let, norm, ws
from colsense.functions.vocab import DAY_WORDS

_SUFFIX = "(?Ud)" + ws(r"\s*(days?|d)\s*$")
_PLAIN_DAYS = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


#: Texts of ASCII letters alone, lower-cased, that are a count of days ("ten", "tendays").
DAY_LETTERS = [w + end for w in DAY_WORDS for end in ("", "d", "day", "days") if end or not w.endswith(("d", "day", "days"))]


def duration_days(c) -> Column:
    """Days as DOUBLE, or null.  ``P<n>D``; ``<n>[ day|days|d]``; zero..ten."""
    words = F.create_map(*[x for k, v in DAY_WORDS.items() for x in (F.lit(k), F.lit(float(v)))])

    def plain(u):
        return F.when(u.rlike(_PLAIN_DAYS), u.cast("double")).otherwise(F.element_at(words, u))

    def days(s):
        iso = s.startswith("p") & s.endswith("d")
        iso_days = guarded_double(F.substr(s, F.lit(2), F.length(s) - 2))
        # ``s`` is trimmed: without one of these ends there is no suffix to remove
        suffix = s.endswith("d") | s.endswith("day") | s.endswith("days")
        return F.when(iso, iso_days).otherwise(let(F.when(suffix, F.regexp_replace(s, _SUFFIX, "")).otherwise(s), plain))

    return let(let(norm(c), days), lambda d: F.when(~F.isnan(d), d))


def days_to_interval(days) -> Column:
    """DOUBLE days -> INTERVAL DAY TO SECOND (microseconds; null on overflow)."""
    return F.try_multiply(F.make_dt_interval(F.lit(1)), days)


def to_duration(c) -> Column:
    return days_to_interval(duration_days(c))


def interval_seconds(c) -> Column:
    """Interval -> seconds as DOUBLE (for exports)."""
    i = c if isinstance(c, Column) else F.col(c)
    return (F.extract(F.lit("DAY"), i) * 86400 + F.extract(F.lit("HOUR"), i) * 3600
            + F.extract(F.lit("MINUTE"), i) * 60).cast("double") + F.extract(F.lit("SECOND"), i).cast("double")
