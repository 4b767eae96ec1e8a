"""Dirty numeric text -> number, as native Column expressions.

``numeric_parts(c)`` returns a struct with
  ok       - the value is a number (real or complex)
  value    - the real value as DOUBLE (null for complex literals)
  token    - the cleaned decimal text of the plain branch (exact BIGINT parse)
  cplx     - the value came from the complex branch
  re, im   - complex parts (re = value, im = 0 for real numbers)

Branch order follows the rules: complex literal (returns), currency strip
(rewrites and continues), percent (returns), scientific (returns), thousands
and decimal separators, final float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions.text import as_col, guarded_double, let, norm, py_strip, ws
from colsense.functions.vocab import CURRENCY_CODES, CURRENCY_SYMBOLS

_SYMBOLS = "[" + "".join(CURRENCY_SYMBOLS) + "]"
_AMOUNT = r"([0-9][,.0-9]*)"


def _symbol(currency_codes: bool) -> str:
    if not currency_codes:
        return _SYMBOLS
    return "(?:" + _SYMBOLS + "|" + "|".join(c.lower() for c in CURRENCY_CODES) + ")"


def currency_prefix_regex(currency_codes: bool = False) -> str:
    # sign, symbol, amount; nothing required after the amount
    return "(?U)" + ws(r"^([+-]?\s*)" + _symbol(currency_codes) + r"\s*" + _AMOUNT)


def currency_suffix_regex(currency_codes: bool = False) -> str:
    # amount then symbol at the very end; anchored and signed (fix Q4)
    return "(?U)" + ws(r"^([+-]?\s*)" + _AMOUNT + r"\s*" + _symbol(currency_codes) + "$")


# Complex literal grammar of Python's complex(): <float>j | <float><sign>[<float>]j | [<sign>]j
_UFLOAT = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
COMPLEX_REGEX = (r"^(?:([+-]?" + _UFLOAT + r")j|([+-]?" + _UFLOAT + r")([+-])(" + _UFLOAT
                 + r")?j|([+-]?)j)$")
_BRACKETED = r"(?s)^\((.*)\)$"
_INT_TOKEN = "(?U)^" + ws(r"\s*[+-]?[0-9]+\s*") + "$"
_MAX_ABS_INT = 9.223372036854775807e18


def _signed_one(sign: Column) -> Column:
    return F.when(sign == "-", F.lit(-1.0)).otherwise(F.lit(1.0))


def complex_parts(s: Column) -> Column:
    """N1 on an already trimmed, lower-cased value: struct(ok, re, im)."""
    z = F.regexp_replace(F.regexp_replace(s, "i", "j"), "(?U)([0-9])" + ws(r"\s*") + "j", "$1j")

    def parse(body):
        def fields(g):
            imag_only = g[0] != ""
            both = g[2] != ""
            re_ = F.when(both, g[1].cast("double")).otherwise(F.lit(0.0))
            im = (F.when(imag_only, g[0].cast("double"))
                  .when(both, F.when(g[3] != "", F.concat(g[2], g[3]).cast("double"))
                        .otherwise(_signed_one(g[2])))
                  .otherwise(_signed_one(g[4])))
            return F.when(g.isNotNull(), F.struct(F.lit(True).alias("ok"), re_.alias("re"),
                                                  im.alias("im")))
        groups = F.when(body.rlike(COMPLEX_REGEX),
                        F.array(*[F.regexp_extract(body, COMPLEX_REGEX, i) for i in range(1, 6)]))
        parsed = let(groups, fields)
        return F.coalesce(parsed, F.struct(F.lit(False).alias("ok"),
                                           F.lit(None).cast("double").alias("re"),
                                           F.lit(None).cast("double").alias("im")))

    def unbracket(zz):
        # "(3+4j)" -> "3+4j"; blanks inside the brackets are allowed
        return let(F.when(zz.rlike(_BRACKETED), py_strip(F.regexp_extract(zz, _BRACKETED, 1)))
                   .otherwise(zz), parse)

    return let(z, unbracket)


def strip_currency(s: Column, currency_codes: bool = False) -> Column:
    """Keep the signed amount of a currency value, else the value itself."""
    pre, suf = currency_prefix_regex(currency_codes), currency_suffix_regex(currency_codes)

    def signed(rx):
        sign = F.when(F.regexp_extract(s, rx, 1).contains("-"), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.regexp_extract(s, rx, 2))

    has_symbol = F.length(F.translate(s, "".join(CURRENCY_SYMBOLS), "")) < F.length(s)
    if currency_codes:
        has_symbol = has_symbol | s.rlike("|".join(c.lower() for c in CURRENCY_CODES))
    return (F.when(~has_symbol, s).when(s.rlike(pre), signed(pre))
            .when(s.rlike(suf), signed(suf)).otherwise(s))


def separators(t: Column, strict_numbers: bool = False) -> Column:
    """Drop commas; with several dots keep only the last one."""
    def dots(u):
        several = F.length(u) - F.length(F.replace(u, F.lit("."), F.lit(""))) > 1
        if strict_numbers:
            return F.when(~several, u)
        return F.when(several, F.regexp_replace(u, r"(?s)\.(?=.*\.)", "")).otherwise(u)
    return let(F.replace(t, F.lit(","), F.lit("")), dots)


def numeric_parts(c, currency_codes: bool = False, strict_numbers: bool = False) -> Column:
    """The full numeric cleaner."""

    def real(t):
        pct = t.endswith("%")
        sci = t.contains("e")

        def finish(plain):
            value = (F.when(pct, guarded_double(F.regexp_replace(t, "%+$", "")) / F.lit(100.0))
                     .when(sci, guarded_double(t))
                     .otherwise(guarded_double(plain)))
            return let(F.when(~F.isnan(value), value),
                       lambda v: F.struct(v.isNotNull().alias("ok"), v.alias("value"),
                                          F.when(v.isNotNull() & ~pct & ~sci, plain).alias("token"),
                                          F.lit(False).alias("cplx"), v.alias("re"),
                                          F.when(v.isNotNull(), F.lit(0.0)).alias("im")))
        return let(separators(t, strict_numbers), finish)

    def branch(s):
        is_cplx = s.contains("i") | s.contains("j")

        def from_complex(cp):
            return F.struct(cp["ok"].alias("ok"), F.lit(None).cast("double").alias("value"),
                            F.lit(None).cast("string").alias("token"), cp["ok"].alias("cplx"),
                            cp["re"].alias("re"), cp["im"].alias("im"))
        return F.when(is_cplx, let(complex_parts(s), from_complex)).otherwise(
            let(strip_currency(s, currency_codes), real))

    return let(norm(c), branch)


def is_integral(value: Column) -> Column:
    """N7 per value: integral and inside BIGINT range."""
    return (value == F.floor(value)) & (F.abs(value) < F.lit(_MAX_ABS_INT))


def to_double(c, **kw) -> Column:
    return numeric_parts(c, **kw)["value"]


def to_bigint(parts: Column) -> Column:
    """Exact BIGINT: integral tokens keep every digit (fix Q7)."""
    def pick(p):
        tok = p["token"]
        exact = F.when(tok.rlike(_INT_TOKEN), py_strip(tok).try_cast("bigint"))
        return F.coalesce(exact, F.when(is_integral(p["value"]), p["value"].cast("bigint")))
    return let(parts, pick)


def to_complex(parts: Column) -> Column:
    return let(parts, lambda p: F.when(p["ok"], F.struct(p["re"].alias("re"), p["im"].alias("im"))))


def strict_double(c) -> Column:
    """O1: to_numeric on the raw value - no currency, percent or comma handling."""
    return guarded_double(as_col(c))

