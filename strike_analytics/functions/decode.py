"""Column expressions for decoding substitution-encoded strike frames.

Every function here returns a native Spark ``Column`` (no Python UDF), so a
decode is one projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The substitution table of the feed.
#
# Keys are the two-byte UTF-8 sequences C4 xx / C5 xx of the feed, written
# here as the code points they encode (U+0100 ... U+017F). Each maps to the
# ASCII text that replaces it; "" deletes the character. On valid UTF-8 each
# key is exactly one character, so a character translation is equivalent to
# the byte replacement of the feed.
# ---------------------------------------------------------------------------
SUBSTITUTIONS: dict[str, str] = {
    "Ā": "",
    "ā": "",
    "ă": "",
    "ą": "",
    "Ć": ": ",
    "ć": ".",
    "Ĉ": "0", "ĉ": "1", "Ċ": "2", "ċ": "3", "Č": "4",
    "č": "5", "Ď": "6", "ď": "7", "Đ": "8", "đ": "9",
    "Ē": "2", "ē": "3", "Ĕ": "4", "ĕ": "5", "Ė": "6",
    "ė": "7", "Ę": "8", "ę": "9", "Ě": "0", "ě": "1",
    "Ĝ": '"', "ĝ": '"', "Ğ": '"', "ğ": '"',
    "Ġ": "0", "ġ": "1", "Ģ": "2", "ģ": "3", "Ĥ": "4",
    "ĥ": "5", "Ħ": "6", "ħ": "7", "Ĩ": "8", "ĩ": "9",
    "Ī": "",
    "ī": "",
    "Ĭ": "",
    "ĭ": "",
    "Į": "",
    "İ": '"', "ı": '"', "Ĳ": '"', "ĳ": '"', "Ĵ": '"', "ĵ": '"',
    "Ķ": "",
    "ĸ": '"', "Ĺ": '"', "ĺ": '"', "Ļ": '"', "ļ": '"', "Ľ": '"',
    "ľ": "",
    "ŀ": "",
    "Ł": "",
    "ń": "4",
    "Ņ": "5",
    "ņ": "6",
    "ň": "8",
    "ŉ": "9",
    "ō": "",
    "ś": "",
}

# The field patterns (Python ``re`` syntax of the feed decoder).
# ``\s`` there is Unicode whitespace; Java's ``\s`` is ASCII only, so the
# class is spelled out below from Python's own definition (str.isspace).


def _py_space_class() -> str:
    """Python's whitespace set as compact regex ranges (e.g. ``\\u0009-\\u000d``)."""
    points = [c for c in range(0x3001) if chr(c).isspace()]
    runs, start = [], points[0]
    for prev, cur in zip(points, points[1:] + [None]):
        if cur != prev + 1:
            runs.append(f"\\u{start:04x}" + (f"-\\u{prev:04x}" if prev != start else ""))
            start = cur
    return "".join(runs)


_PY_SPACE = _py_space_class()
PATTERNS: dict[str, str] = {
    "time": r'time[":]+(\d+)',
    "lat": r"lat[:" + _PY_SPACE + r"]*([0-9.-]+)",
    "lon": r"lon[:" + _PY_SPACE + r"]*([0-9.-]+)",
    "alt": r'"?al"?[:' + _PY_SPACE + r"]*([0-9.-]+)",
    "pol": r"pol[:" + _PY_SPACE + r']*"?([^"]+)"?',
    "mds": r"mds[:" + _PY_SPACE + r"]*([0-9.-]+)",
    "mcg": r"mcg[:" + _PY_SPACE + r"]*([0-9.-]+)",
}
# Leading / trailing Python whitespace (for the lenient ``str.strip``).
_PY_STRIP = "^[" + _PY_SPACE + "]+|[" + _PY_SPACE + "]+$"

# Epoch unit thresholds (strictly greater than) and the last
# representable second of year 9999 in each unit. The microsecond bound is the
# largest value whose seconds (as a float) still round below year 10000.
MICROS_THRESHOLD = 10**15
MILLIS_THRESHOLD = 10**12
MAX_SECONDS = 253402300799
MAX_MILLIS = 253402300799999
MAX_MICROS = 253402300799999984

# Fixed value: the longest integer literal Python's json module converts
# (sys.get_int_max_str_digits() default).
PY_INT_MAX_DIGITS = 4300

# Storage limits of the strike table (INTEGER columns, VARCHAR(50)).
INT32_MIN = -2147483648
INT32_MAX = 2147483647
POLARITY_MAX_CHARS = 50


def _translation() -> tuple[str, str, str]:
    """(from, to) for ``translate`` plus the one multi-character key.

    ``translate`` maps one character to one character and deletes characters
    that have no counterpart in ``to``; the single two-character output
    (colon + space) is applied with ``replace`` beforehand.
    """
    multi = [k for k, v in SUBSTITUTIONS.items() if len(v) > 1]
    assert len(multi) == 1
    single = [(k, v) for k, v in SUBSTITUTIONS.items() if len(v) == 1]
    deleted = [k for k, v in SUBSTITUTIONS.items() if v == ""]
    src = "".join(k for k, _ in single) + "".join(deleted)
    dst = "".join(v for _, v in single)
    return src, dst, multi[0]


_SRC, _DST, _MULTI_KEY = _translation()


def payload_text(payload: Column) -> Column:
    """Bytes -> text; invalid UTF-8 sequences become U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


def substitute(text: Column) -> Column:
    """Apply the substitution table to decoded text."""
    return F.translate(F.replace(text, F.lit(_MULTI_KEY), F.lit(SUBSTITUTIONS[_MULTI_KEY])), _SRC, _DST)


def decode_payload(payload: Column) -> Column:
    """Raw frame bytes -> substituted text."""
    return substitute(payload_text(payload))


def extract(text: Column, field: str) -> Column:
    """First match of the field's pattern, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, PATTERNS[field], 1), F.lit(""))


def parse_double(s: Column) -> Column:
    """Python ``float(s)`` on the ``[0-9.-]+`` captures; NULL when unparsable."""
    return s.try_cast("double")


def is_finite(d: Column) -> Column:
    return ~(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))))


def truncate_int(d: Column, to: str = "int") -> Column:
    """``int(float(s))``: truncation toward zero; NULL when out of range."""
    return d.try_cast(to)


def in_int32_after_trunc(d: Column) -> Column:
    """Whether trunc(d) fits a 32-bit INTEGER column."""
    return (d > F.lit(INT32_MIN - 1)) & (d < F.lit(INT32_MAX + 1))


def python_strip(s: Column) -> Column:
    """``str.strip()`` with Python's whitespace definition."""
    return F.regexp_replace(s, _PY_STRIP, "")


def integer_digits(v: Column) -> Column:
    """``str(abs(int(v)))`` for a finite double ``v``.

    Exact below 1e18 (via LONG). Above that every double is an integer and
    the digits come from ``%.0f``, i.e. Java's shortest-repr digits padded
    with zeros; Python prints the exact binary value instead, which can move
    the repaired value by one unit in the last place.
    """
    a = F.abs(v)
    return F.when(a < F.lit(1e18), a.cast("long").cast("string")) \
            .otherwise(F.format_string("%.0f", a))


def repair_longitude_parts(v: Column, digits: Column) -> Column:
    """Longitude repair from its parsed value ``v`` and ``integer_digits(v)``.

    |v| <= 1000 or fewer than 6 integer digits: unchanged. 7 or 8 digits:
    point after the first two digits. 6 or >= 9 digits: point after the first
    digit (the first candidate that is <= 180). Any fraction is dropped and the
    sign restored. Unparsable or infinite text gives NULL.

    Pass column references, not expressions: each argument is used several
    times, so ``with_repaired_longitude`` stages them as columns first.
    """
    n = F.length(digits)
    two = F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 1 << 20))
    one = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 1 << 20))
    moved = F.when(n.isin(7, 8), two.cast("double")).otherwise(one.cast("double"))
    return (F.when(v.isNull() | ~is_finite(v), F.lit(None).cast("double"))
             .when(F.abs(v) <= 1000, v)
             .when(n < 6, v)
             .when(v < 0, -moved)
             .otherwise(moved))


def epoch_unit(raw: Column) -> Column:
    """'us' above 1e15, 'ms' above 1e12, else 's' (comparisons are strict)."""
    return (F.when(raw > F.lit(MICROS_THRESHOLD), F.lit("us"))
             .when(raw > F.lit(MILLIS_THRESHOLD), F.lit("ms"))
             .when(raw.isNotNull(), F.lit("s")))


def epoch_to_timestamp(raw: Column) -> Column:
    """Epoch number in its detected unit -> NTZ timestamp; NULL past year 9999."""
    from .timeutil import from_epoch
    return (F.when(raw > F.lit(MICROS_THRESHOLD),
                   F.when(raw <= F.lit(MAX_MICROS), from_epoch("MICROSECOND", raw)))
             .when(raw > F.lit(MILLIS_THRESHOLD),
                   F.when(raw <= F.lit(MAX_MILLIS), from_epoch("MILLISECOND", raw)))
             .when(raw.isNotNull(),
                   F.when(raw <= F.lit(MAX_SECONDS), from_epoch("SECOND", raw))))
