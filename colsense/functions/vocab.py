"""Fixed vocabularies of the typing rules.

Everything in the block below is a fixed value: the spellings, thresholds and
labels must equal the ones of the behaviour we reproduce, so they are written
out plainly and in their natural order.  Derived helpers follow after it.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must not be edited to make a result change)
# ---------------------------------------------------------------------------

# Exact spellings of "missing" (case-sensitive, not trimmed).
MISSING_TOKENS = [
    "NA", "NaN", "N/A", "Not Available", "null", "", " ", "--", "-", "?",
    "missing", "undefined", "unknown", "N.A.", "none", "nil", "(empty)",
    "not specified", "n/s", "pending", "tbd", "to be determined",
]

# Spellings a pandas CSV reader turns into NaN before typing starts (its
# default na_values).  Folded into the exact set because every value reached
# the typing rules through that reader.
READER_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Whole-value patterns of "missing", matched case-insensitively.
MISSING_PATTERNS = [
    r"^\s*$", r"^-*$", r"^null$", r"^n/?a$", r"^not\s+available$",
    r"^missing$", r"^undefined$", r"^unknown$", r"^n\.a\.$", r"^none$",
    r"^nil$", r"^\(empty\)$", r"^not\s+specified$", r"^n/s$",
    r"^pending$", r"^tbd$", r"^to\s+be\s+determined$",
]

# Boolean spellings (compared after trimming and lower-casing).
BOOLEAN_VALUES = {
    "true": True, "false": False,
    "yes": True, "no": False,
    "y": True, "n": False,
    "t": True, "f": False,
    "1": True, "0": False,
    "on": True, "off": False,
    "enabled": True, "disabled": False,
    "active": True, "inactive": False,
    "positive": True, "negative": False,
    "success": True, "failure": False,
    "pass": True, "fail": False,
}

# Number words accepted as a count of days.
DAY_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4,
    "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10,
}

# Currency symbols recognised before or after an amount.
CURRENCY_SYMBOLS = ["$", "€", "£", "¥"]
# Currency codes; listed upper case, so after lower-casing they never match
# unless the caller opts in with currency_codes=True.
CURRENCY_CODES = ["EUR", "USD", "GBP", "JPY", "AUD", "CNY"]

# Categorical thresholds: (max rows, max distinct ratio, max distinct count);
# a column is categorical when either limit holds.  Rows above the last bound
# use CATEGORY_TAIL.
CATEGORY_THRESHOLDS = [
    (10, 0.5, 3),
    (100, 0.5, 10),
    (1000, 0.3, 20),
    (10000, 0.1, 50),
    (100000, 0.05, 100),
    (1000000, 0.02, 200),
]
CATEGORY_TAIL = (0.01, 500)

# Decision ratios.
NUMERIC_MIN_RATIO = 0.8      # inclusive
DURATION_MIN_RATIO = 0.9     # exclusive
DATETIME_MIN_RATIO = 0.9     # exclusive

# Defaults of the original tool.
DEFAULT_CHUNK_ROWS = 100000
ERROR_SAMPLE_SIZE = 5
DEFAULT_PAGE_SIZE = 10

# Display names of the logical types.
TYPE_LABELS = {
    "float64": "Numeric (float64)",
    "Int64": "Numeric (Int64)",
    "complex128": "Complex Number",
    "datetime64[ns]": "Date",
    "timedelta64[ns]": "Duration",
    "bool": "Boolean",
    "category": "Categorical",
    "object": "Text",
    "string": "Text",
}

# ---------------------------------------------------------------------------
# Derived values
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (str.isspace), as one string; used
# with btrim so Spark trims exactly what Python trims.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Java-regex character class for the same set (\s under (?U) lacks \x1c-\x1f).
WS_CLASS = r"[\s\x{1c}-\x{1f}]"

ALL_MISSING_TOKENS = list(dict.fromkeys(MISSING_TOKENS + READER_NULL_TOKENS))

TRUE_KEYS = [k for k, v in BOOLEAN_VALUES.items() if v]
FALSE_KEYS = [k for k, v in BOOLEAN_VALUES.items() if not v]

# Logical type names.
BOOL = "bool"
INT = "Int64"
FLOAT = "float64"
COMPLEX = "complex128"
CATEGORY = "category"
DURATION = "timedelta64[ns]"
DATETIME = "datetime64[ns]"
OBJECT = "object"
STRING = "string"
