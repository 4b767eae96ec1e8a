"""DuckDB SQL for the oracle side of the driver queries.

The same rules as the Spark cleaners, written independently as staged CTEs
for DuckDB's RE2 engine (no look-ahead, no (?U) flag: Python's blank set is
spelled out as an explicit class).  Only the fixed vocabularies are shared.
"""

from __future__ import annotations

from colsense.functions import vocab as V
from colsense.functions.numeric import COMPLEX_REGEX

RE2_WS = "[" + "".join(
    {"\t": r"\t", "\n": r"\n", "\x0b": r"\x0b", "\x0c": r"\x0c", "\r": r"\r", " ": " "}.get(ch)
    or "\\x{%x}" % ord(ch) for ch in V.PY_WHITESPACE) + "]"
WS_CHARS = V.PY_WHITESPACE
FLOAT_BODY = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
FLOAT_CAPTURE = "^" + RE2_WS + "*(" + FLOAT_BODY + ")" + RE2_WS + "*$"
SYMBOLS = "[" + "".join(V.CURRENCY_SYMBOLS) + "]"
PREFIX = r"^([+-]?" + RE2_WS + "*)" + SYMBOLS + RE2_WS + r"*([0-9][,.0-9]*)"
SUFFIX = r"^([+-]?" + RE2_WS + r"*)([0-9][,.0-9]*)" + RE2_WS + "*" + SYMBOLS + "$"
MISSING_RE2 = "(?i)" + "|".join(p.replace(r"\s", RE2_WS) for p in V.MISSING_PATTERNS)

# (shape, [strptime formats]) - the subset of the closed list the oracle data uses
DATE_SHAPES = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", ["%Y-%m-%d"]),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$",
     ["%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M"]),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$",
     ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M"]),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", ["%Y/%m/%d"]),
    (r"^[0-9]{4}-[0-9]{1,2}$", ["%Y-%m"]),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ["%m/%d/%Y", "%d/%m/%Y"]),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", ["%m-%d-%Y", "%d-%m-%Y"]),
    (r"^[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}$", ["%d %b %Y", "%d %B %Y"]),
    (r"^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}$", ["%b %d, %Y", "%B %d, %Y"]),
    (r"^[A-Za-z]{3,9} [0-9]{1,2} [0-9]{4}$", ["%b %d %Y", "%B %d %Y"]),
    (r"^[0-9]{8}$", ["%Y%m%d"]),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(WS_CHARS)})"


def fdouble(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, {q(FLOAT_CAPTURE)}, 1), '') AS DOUBLE)"


def is_missing(x: str) -> str:
    return (f"({x} IS NULL OR {x} IN {in_list(V.ALL_MISSING_TOKENS)} "
            f"OR regexp_matches({x}, {q(MISSING_RE2)}))")


def bool_value(x: str) -> str:
    n = f"lower({strip(x)})"
    return (f"(CASE WHEN {n} IN {in_list(V.TRUE_KEYS)} THEN TRUE "
            f"WHEN {n} IN {in_list(V.FALSE_KEYS)} THEN FALSE END)")


def datetime_value(x: str) -> str:
    s = f"regexp_replace(regexp_replace({strip(x)}, '^[A-Za-z]{{3}}, ', ''), '(\\.[0-9]{{6}})[0-9]+', '\\1')"
    parts = []
    for shape, fmts in DATE_SHAPES:
        for f in fmts:
            parts.append(f"CASE WHEN regexp_matches({s}, {q(shape)}) THEN try_strptime({s}, {q(f)}) END")
    return "CAST(COALESCE(" + ", ".join(parts) + ") AS TIMESTAMP)"


def numeric_cte(src: str, value: str = "value") -> str:
    """SELECT over ``src`` adding num_ok, num_value, token, cplx, re, im."""
    words = " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in V.DAY_WORDS.items())
    return f"""
    (WITH a AS (SELECT *, lower({strip(value)}) AS _s FROM {src}),
    b AS (SELECT *,
        (contains(_s, 'i') OR contains(_s, 'j')) AS _is_cplx,
        regexp_replace(replace(_s, 'i', 'j'), '([0-9]){RE2_WS}*j', '\\1j', 'g') AS _z,
        CASE WHEN length(translate(_s, {q(''.join(V.CURRENCY_SYMBOLS))}, '')) = length(_s) THEN _s
             WHEN regexp_matches(_s, {q(PREFIX)}) THEN
               (CASE WHEN contains(regexp_extract(_s, {q(PREFIX)}, 1), '-') THEN '-' ELSE '' END)
               || regexp_extract(_s, {q(PREFIX)}, 2)
             WHEN regexp_matches(_s, {q(SUFFIX)}) THEN
               (CASE WHEN contains(regexp_extract(_s, {q(SUFFIX)}, 1), '-') THEN '-' ELSE '' END)
               || regexp_extract(_s, {q(SUFFIX)}, 2)
             ELSE _s END AS _t
      FROM a),
    c AS (SELECT *,
        CASE WHEN regexp_matches(_z, '(?s)^\\((.*)\\)$')
             THEN {strip("regexp_extract(_z, '(?s)^\\((.*)\\)$', 1)")} ELSE _z END AS _body,
        ends_with(_t, '%') AS _pct, contains(_t, 'e') AS _sci, replace(_t, ',', '') AS _u
      FROM b),
    d AS (SELECT *,
        regexp_matches(_body, {q(COMPLEX_REGEX)}) AS _cm,
        regexp_extract(_body, {q(COMPLEX_REGEX)}, 1) AS _g1,
        regexp_extract(_body, {q(COMPLEX_REGEX)}, 2) AS _g2,
        regexp_extract(_body, {q(COMPLEX_REGEX)}, 3) AS _g3,
        regexp_extract(_body, {q(COMPLEX_REGEX)}, 4) AS _g4,
        regexp_extract(_body, {q(COMPLEX_REGEX)}, 5) AS _g5,
        CASE WHEN length(_u) - length(replace(_u, '.', '')) > 1
             THEN replace(substr(_u, 1, length(_u) - instr(reverse(_u), '.')), '.', '')
                  || substr(_u, length(_u) - instr(reverse(_u), '.') + 1)
             ELSE _u END AS _plain
      FROM c),
    e AS (SELECT *,
        CASE WHEN _pct THEN {fdouble("rtrim(_t, '%')")} / 100.0
             WHEN _sci THEN {fdouble("_t")}
             ELSE {fdouble("_plain")} END AS _v0
      FROM d)
    SELECT *,
      CASE WHEN _is_cplx THEN _cm ELSE (_v0 IS NOT NULL AND NOT isnan(_v0)) END AS num_ok,
      CASE WHEN NOT _is_cplx AND NOT isnan(_v0) THEN _v0 END AS num_value,
      CASE WHEN NOT _is_cplx AND NOT isnan(_v0) AND NOT _pct AND NOT _sci THEN _plain END AS token,
      (_is_cplx AND _cm) AS cplx,
      CASE WHEN _is_cplx AND _cm THEN (CASE WHEN _g3 <> '' THEN CAST(_g2 AS DOUBLE) ELSE 0.0 END)
           WHEN NOT _is_cplx AND NOT isnan(_v0) THEN _v0 END AS re,
      CASE WHEN _is_cplx AND _cm THEN
             (CASE WHEN _g1 <> '' THEN CAST(_g1 AS DOUBLE)
                   WHEN _g3 <> '' THEN (CASE WHEN _g4 <> '' THEN CAST(_g3 || _g4 AS DOUBLE)
                                             WHEN _g3 = '-' THEN -1.0 ELSE 1.0 END)
                   WHEN _g5 = '-' THEN -1.0 ELSE 1.0 END)
           WHEN NOT _is_cplx AND NOT isnan(_v0) THEN 0.0 END AS im,
      (CASE WHEN starts_with(_s, 'p') AND ends_with(_s, 'd')
            THEN {fdouble("substr(_s, 2, length(_s) - 2)")}
            WHEN regexp_matches(regexp_replace(_s, '{RE2_WS}*(days?|d){RE2_WS}*$', ''),
                                '^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$')
            THEN CAST(regexp_replace(_s, '{RE2_WS}*(days?|d){RE2_WS}*$', '') AS DOUBLE)
            ELSE (CASE regexp_replace(_s, '{RE2_WS}*(days?|d){RE2_WS}*$', '') {words} END) END) AS dur_days
    FROM e)"""


def bigint_value(prefix: str = "") -> str:
    """Exact BIGINT from the numeric columns (integral tokens keep digits)."""
    return (f"COALESCE(CASE WHEN regexp_matches({prefix}token, '^{RE2_WS}*[+-]?[0-9]+{RE2_WS}*$') "
            f"THEN TRY_CAST({strip(prefix + 'token')} AS BIGINT) END, "
            f"CASE WHEN {prefix}num_value = floor({prefix}num_value) "
            f"AND abs({prefix}num_value) < 9.223372036854775807e18 "
            f"THEN CAST({prefix}num_value AS BIGINT) END)")


def flags_cte(src: str) -> str:
    """Per-value flags over ``src`` (which has a ``value`` column)."""
    return f"""
    (SELECT *,
       {is_missing('value')} AS missing,
       (lower({strip('value')}) IN {in_list(list(V.BOOLEAN_VALUES))}) AS boolish,
       COALESCE(num_value = floor(num_value) AND abs(num_value) < 9.223372036854775807e18, FALSE) AS integral,
       (dur_days IS NOT NULL AND NOT isnan(dur_days)) AS dur_ok,
       ({datetime_value('value')} IS NOT NULL) AS dt_ok
     FROM {numeric_cte(src)})"""


def long_sql(table_sql: str, cols, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f'SELECT {g}{q(c)} AS "column", {i} AS position, CAST({c} AS VARCHAR) AS value FROM ({table_sql})'
        for i, c in enumerate(cols))


def category_limits_sql(n: str) -> tuple[str, str]:
    r = " ".join(f"WHEN {n} <= {b} THEN {x}" for b, x, _ in V.CATEGORY_THRESHOLDS)
    c = " ".join(f"WHEN {n} <= {b} THEN {x}" for b, _, x in V.CATEGORY_THRESHOLDS)
    return (f"(CASE {r} ELSE {V.CATEGORY_TAIL[0]} END)", f"(CASE {c} ELSE {V.CATEGORY_TAIL[1]} END)")


def profile_sql(table_sql: str, cols, group: str = "", override_fail: dict | None = None) -> str:
    """Per (group, column) profile: same fields as colsense.operators.profile.

    ``override_fail`` maps column -> SQL predicate over ``value`` (raw text)."""
    g = f"{group}, " if group else ""
    ofail = "FALSE"
    if override_fail:
        ofail = "CASE " + " ".join(f'WHEN "column" = {q(c)} THEN ({p})' for c, p in override_fail.items()) \
                + " ELSE FALSE END"
    per_value = (f'SELECT {g}"column", position'
                 f", value, CAST(count(*) AS BIGINT) AS cnt "
                 f"FROM ({long_sql(table_sql, cols, group)}) GROUP BY ALL")
    return f"""
    SELECT {g}"column", position,
      CAST(sum(cnt) AS BIGINT) AS n_rows,
      CAST(sum(CASE WHEN missing THEN cnt ELSE 0 END) AS BIGINT) AS n_missing,
      CAST(sum(cnt) - sum(CASE WHEN missing THEN cnt ELSE 0 END) AS BIGINT) AS n_non_null,
      CAST(sum(CASE WHEN NOT missing THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct,
      bool_and(CASE WHEN NOT missing THEN boolish END) AS all_bool,
      CAST(sum(CASE WHEN NOT missing THEN cnt ELSE 0 END) AS BIGINT) AS n_sampled,
      CAST(sum(CASE WHEN NOT missing AND num_ok THEN cnt ELSE 0 END) AS BIGINT) AS n_numeric,
      COALESCE(bool_or(NOT missing AND num_ok AND cplx), FALSE) AS any_complex,
      COALESCE(bool_and(CASE WHEN NOT missing AND num_ok AND NOT cplx THEN integral END), TRUE) AS all_integral,
      CAST(sum(CASE WHEN NOT missing AND dur_ok THEN cnt ELSE 0 END) AS BIGINT) AS n_duration,
      CAST(sum(CASE WHEN NOT missing AND dt_ok THEN cnt ELSE 0 END) AS BIGINT) AS n_datetime,
      CAST(sum(CASE WHEN {ofail} THEN cnt ELSE 0 END) AS BIGINT) AS n_override_fail
    FROM {flags_cte('(' + per_value + ')')}
    GROUP BY ALL"""


def decide_sql(profile: str, overrides: dict | None = None) -> str:
    """Add requested_type, override_failed, inferred_type to a profile query."""
    overrides = overrides or {}
    req = "CAST(NULL AS VARCHAR)"
    if overrides:
        req = "CASE " + " ".join(f'WHEN "column" = {q(c)} THEN {q(t)}' for c, t in overrides.items()) + " END"
    mr, mc = category_limits_sql("n_rows")
    return f"""
    SELECT *, CASE WHEN req_ok THEN requested_type ELSE
      CASE WHEN n_non_null = 0 THEN 'object'
           WHEN all_bool THEN 'bool'
           WHEN n_numeric / n_sampled >= {V.NUMERIC_MIN_RATIO} THEN
             CASE WHEN any_complex THEN 'complex128' WHEN all_integral THEN 'Int64' ELSE 'float64' END
           WHEN n_distinct / n_rows <= {mr} OR n_distinct <= {mc} THEN 'category'
           WHEN n_duration / n_sampled > {V.DURATION_MIN_RATIO} THEN 'timedelta64[ns]'
           WHEN n_datetime / n_sampled > {V.DATETIME_MIN_RATIO} THEN 'datetime64[ns]'
           ELSE 'object' END END AS inferred_type
    FROM (SELECT *, requested_type IS NOT NULL AND NOT req_ok AS override_failed FROM
          (SELECT *, {req} AS requested_type,
                  ({req}) IS NOT NULL AND n_override_fail = 0 AS req_ok FROM ({profile})))"""


_BRACKETED = r"(?s)^\((.*)\)$"
_REAL = r"[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?|nan)"


def override_fails_sql(x: str, type_name: str) -> str:
    """Predicate: a present raw value that the all-or-nothing override rejects."""
    present = f"{x} IS NOT NULL AND {x} NOT IN {in_list(V.READER_NULL_TOKENS)}"
    if type_name == V.DATETIME:
        return f"{present} AND {datetime_value(x)} IS NULL"
    if type_name == V.BOOL:
        return f"{present} AND {bool_value(x)} IS NULL"
    if type_name == "int64":
        return f"{present} AND NOT regexp_matches({x}, '^{RE2_WS}*[+-]?[0-9]+{RE2_WS}*$')"
    if type_name == V.COMPLEX:
        z = "lower(" + strip("replace(" + x + ", 'i', 'j')") + ")"
        inner = strip("regexp_extract(" + z + ", " + q(_BRACKETED) + ", 1)")
        body = f"(CASE WHEN regexp_matches({z}, {q(_BRACKETED)}) THEN {inner} ELSE {z} END)"
        grammar = "^(?:" + _REAL + "|" + COMPLEX_REGEX[1:-1] + ")$"
        return f"{present} AND NOT regexp_matches({body}, {q(grammar)})"
    raise ValueError(type_name)
