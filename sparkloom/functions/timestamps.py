"""Timestamps in text: which are recognised, and patterns in the custom format language of .NET."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How all of them start; and what is recognised: a pattern, and how Spark and Python read it. Fixed values.
START = r"^(?:\d{1,4}[-/ ]|[A-Z][a-z]{2,8} \d)"
TIME, FULL_TIME = r"\d{1,2}:\d{2}", r"\d{1,2}:\d{2}:\d{2}"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)?)?$"
ISO_ZONED = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)? ?(?:Z|[+-]\d{2}:?\d{2})$"
FORMATS: tuple[tuple[str, str, str], ...] = tuple(
    (rf"^{date}{end}$", f"{spark}{spark_end}", f"{python}{python_end}")
    for date, spark, python in (
        (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy", "%m/%d/%Y"),
        (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d", "%Y/%m/%d"),
        (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy", "%m-%d-%Y"),
        (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy", "%d %b %Y"),
        (r"\d{1,2}-[A-Z][a-z]{2}-\d{4}", "d-MMM-yyyy", "%d-%b-%Y"),
        (r"[A-Z][a-z]{2} \d{1,2},? \d{4}", "MMM d[,] yyyy", "%b %d %Y"),
        (r"[A-Z][a-z]{3,8} \d{1,2},? \d{4}", "MMMM d[,] yyyy", "%B %d %Y"),
        (r"\d{1,2} [A-Z][a-z]{3,8} \d{4}", "d MMMM yyyy", "%d %B %Y"),
    )
    for end, spark_end, python_end in (("", "", ""), (f" {TIME}", " H:mm", " %H:%M"), (f" {FULL_TIME}", " H:mm:ss", " %H:%M:%S"), (f" {TIME} [AP]M", " h:mm a", " %I:%M %p"), (f" {FULL_TIME} [AP]M", " h:mm:ss a", " %I:%M:%S %p"))
)


def parse_timestamp(c: Column) -> Column:
    """TIMESTAMP_NTZ, null where the text isn't a timestamp that is recognised. An offset is converted to the session's zone."""
    t = F.trim(c)
    short = lambda x: F.regexp_replace(x, r"(\.\d{6})\d+", "$1")  # noqa: E731  Spark keeps microseconds
    zoned = F.regexp_replace(F.regexp_replace(t, " (?=Z|[+-])", ""), r"([+-]\d{2})(\d{2})$", "$1:$2")
    found = F.when(~t.rlike(START), F.lit(None).cast("timestamp_ntz")).when(t.rlike(ISO), short(t).try_cast("timestamp_ntz")).when(t.rlike(ISO_ZONED), short(zoned).try_cast("timestamp").cast("timestamp_ntz"))
    for pattern, spark, _ in FORMATS:
        found = found.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(spark)).cast("timestamp_ntz"))
    return found


def is_timestamp(text: str) -> bool:
    """The same in Python."""
    t = text.strip()
    if re.match(ISO, t) or re.match(ISO_ZONED, t):
        t = re.sub(r"(\.\d{6})\d+", r"\1", t).replace(" ", "T", 1) if " " in t[:11] else re.sub(r"(\.\d{6})\d+", r"\1", t)
        date, _, time = t.partition("T")
        numbers = [int(x) for x in date.split("-")]
        clock = [int(x) for x in re.match(r"(\d+):(\d+)(?::(\d+))?", time).groups("0")] if time else []
        return _is_real(numbers, clock)
    return any(re.match(pattern, t) and _reads(t, python) for pattern, _, python in FORMATS)


def _is_real(date: list[int], clock: list[int]) -> bool:
    try:
        datetime(*date, *clock)
    except ValueError:
        return False
    return True


def _reads(text: str, python: str) -> bool:
    try:
        datetime.strptime(text.replace(",", ""), python)
    except ValueError:
        return False
    return True


#: Standard formats of one letter, in the invariant culture, as custom ones; and what custom specifiers are to Spark. Fixed values.
STANDARD = {
    "d": "MM/dd/yyyy", "D": "dddd, dd MMMM yyyy", "f": "dddd, dd MMMM yyyy HH:mm", "F": "dddd, dd MMMM yyyy HH:mm:ss", "g": "MM/dd/yyyy HH:mm", "G": "MM/dd/yyyy HH:mm:ss", "M": "MMMM dd", "m": "MMMM dd",
    "o": "yyyy-MM-dd'T'HH:mm:ss.fffffff", "O": "yyyy-MM-dd'T'HH:mm:ss.fffffff", "R": "ddd, dd MMM yyyy HH:mm:ss 'GMT'", "r": "ddd, dd MMM yyyy HH:mm:ss 'GMT'", "s": "yyyy-MM-dd'T'HH:mm:ss", "t": "HH:mm", "T": "HH:mm:ss", "u": "yyyy-MM-dd HH:mm:ss'Z'", "Y": "yyyy MMMM", "y": "yyyy MMMM",
}
SPECIFIERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a", "zzz": "xxx", **{"f" * n: "S" * n for n in range(1, 8)}}
TOKEN = re.compile(r"(?P<quoted>'[^']*'|\"[^\"]*\")|\\(?P<escaped>.)|(?P<run>([A-Za-z])\4*)|(?P<other>[^A-Za-z'\"\\]+)|(?P<bad>['\"\\])")


class FormatError(ValueError):
    """A timestamp format that has no counterpart here."""


def spark_pattern(format: str) -> str:
    """A .NET custom or standard format as one of Spark's patterns; what can't be translated is refused."""
    if len(format) == 1:
        if format not in STANDARD:
            raise FormatError(f"Unsupported timestamp format: '{format}'")
        format = STANDARD[format]
    out, literal = [], ""
    for m in TOKEN.finditer(format.removeprefix("%")):
        run = m["run"]
        if run and run[0] in "yMdHhmstzfFgK":
            if run not in SPECIFIERS:
                raise FormatError(f"Unsupported timestamp specifier '{run}' in format '{format}'")
            out += [_quoted(literal), SPECIFIERS[run]]
            literal = ""
        elif m["bad"]:
            raise FormatError(f"Unbalanced quote or escape in format '{format}'")
        else:
            literal += m["quoted"][1:-1] if m["quoted"] else m["escaped"] or run or m["other"]
    return "".join([*out, _quoted(literal)])


def _quoted(literal: str) -> str:
    doubled = literal.replace("'", "''")
    return f"'{doubled}'" if re.search(r"[A-Za-z'\[\]{}#]", literal) else literal


def format_timestamp(ts: Column, format: str) -> Column:
    return F.date_format(ts, spark_pattern(format))
