"""Lenient parsing of text to typed values, and rendering back to text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.timestamps import format_timestamp, parse_timestamp
from sparkloom.types import LogicalType

#: Numbers as the reference reads them: plain; with thousands; and with trailing sign, parentheses or currency sign too.
WHOLE = r"^\s*[-+]?[0-9]+\s*$"
FLOAT = r"^\s*[-+]?(?:[0-9][0-9,]*\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"
ANY = r"^\s*[(]?\s*¤?\s*[-+]?\s*¤?(?:[0-9][0-9,]*\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*[-+]?\s*[)]?\s*$"
#: Numbers that need none of that, those that are already spelled as they would be written, and those that only have zeros to lose.
SIMPLE = r"^\s*[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?\s*$"
CANONICAL = r"^-?(?:0|[1-9][0-9]{0,17}|[1-9][0-9]{0,8}\.[0-9]{0,4}[1-9]|0\.[0-9]{0,3}[1-9])$"
TRAILING = r"^-?(?:0|[1-9][0-9]{0,8})\.[0-9]{0,3}0$"
#: All that may be a number or a boolean, and no text with other characters, nor what looks like a date.
TYPED = r"(?i)^(?![0-9]+[-/][0-9])(?:[\s(¤+\-.0-9][\s()¤+\-.,0-9e]*|\s*[-+]?(?:nan|infinity|∞|true|false)\s*)$"
#: How text starts that may be a number or a boolean.
MAYBE_TYPED = r"^[\s(¤+\-.0-9tTfFnNiI∞]"
NAMED = r"(?i)^\s*[-+]?(?:nan|infinity|∞)\s*$"
INVALID = "<invalid>"
DEFAULT_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"\S")


def parse_long(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), F.trim(c).try_cast("bigint"))


def parse_double(c: Column) -> Column:
    one_sign = ~c.rlike(r"^\s*[(]?\s*¤?\s*[-+].*[-+]\s*[)]?\s*$") & (c.rlike(r"[(]") == c.rlike(r"[)]")) & ~(c.rlike(r"[(]") & c.rlike(r"^\s*[(][^eE]*[-+]|[-+]\s*[)]"))
    digits = F.regexp_extract(F.regexp_replace(c, ",", ""), r"((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    minus = c.rlike(r"^\s*[(]|^\s*¤?\s*-|-\s*$")
    named = F.when(F.lower(c).contains("nan"), F.lit(math.nan)).otherwise(F.when(F.trim(c).startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf)))
    return F.when(c.rlike(SIMPLE), F.trim(c).try_cast("double")).when(~c.rlike(MAYBE_TYPED), F.lit(None)).when(c.rlike(ANY) & one_sign, F.when(minus, -digits).otherwise(digits)).when(c.rlike(NAMED), named)


def parse_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def double_text(d: Column) -> Column:
    """Shortest text that reads back, with an exponent from 1E+15 and up to 1E-05."""
    return let(d, lambda x: F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "NaN").when(F.abs(x) == math.inf, F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(_finite_text(x)))


def _finite_text(d: Column) -> Column:
    def parts(s: Column) -> Column:
        mantissa, exponent = F.regexp_extract(s, r"^([0-9.]+)", 1), F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
        return F.struct(F.concat(whole, part).alias("digits"), (F.length(whole) + exponent).alias("point"))

    def trimmed(p: Column) -> Column:
        """Digits without zeros at either end, and how many of them stand before the point."""
        lead = F.length(F.regexp_extract(p["digits"], "^(0*)", 1))
        return F.struct(F.regexp_replace(p["digits"], "^0+|0+$", "").alias("digits"), (p["point"] - lead).alias("point"))

    def text(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        n, power = F.length(digits), point - 1
        rest = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        sci = F.concat(F.left(digits, F.lit(1)), rest, F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
        )
        return F.when(digits == "", "0").when((power >= 15) | (power < -4), sci).otherwise(plain)

    # -0.0 is told from 0.0 by its text
    sign = F.when(d.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, let(F.abs(d).cast("string"), lambda s: let(parts(s), lambda p: let(trimmed(p), text))))


def double_text_py(d: float) -> str:
    """double_text in Python."""
    if math.isnan(d):
        return "NaN"
    if math.isinf(d):
        return "Infinity" if d > 0 else "-Infinity"
    sign, digits, exponent = _digits(d)
    if not digits:
        return sign + "0"
    if exponent >= 15 or exponent < -4:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}E{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    whole = digits[: exponent + 1].ljust(exponent + 1, "0")
    return f"{sign}{whole}{'.' + digits[exponent + 1 :] if len(digits) > exponent + 1 else ''}"


def _digits(d: float) -> tuple[str, str, int]:
    mantissa, _, power = f"{d!r}".lstrip("-").partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    return "-" if f"{d!r}".startswith("-") else "", digits.strip("0"), len(whole) - 1 + int(power or 0) - lead


def render(c: Column, type: LogicalType, format: str | None = None) -> Column:
    """A cell as a typed column shows it."""
    if type is LogicalType.WholeNumber:
        shown = parse_long(c).cast("string")
    elif type is LogicalType.FloatingPoint:
        shown = double_text(parse_double(c))
    elif type is LogicalType.Boolean:
        shown = parse_bool(c).cast("string")
    elif type is LogicalType.Timestamp:
        shown = format_timestamp(parse_timestamp(c), format or DEFAULT_TIMESTAMP)
    else:
        return c
    return F.coalesce(shown, F.lit(INVALID))


def escaped(c: Column) -> Column:
    """Text with line ends, tabs and quotes escaped for a tree."""
    for plain, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    return c


def json_encoding(c: Column) -> Column:
    """How text goes into a JSON line: bool, number or text."""
    return F.when(parse_bool(c).isNotNull(), "bool").when(parse_long(c).isNotNull() | parse_double(c).isNotNull(), "number").otherwise("text")


def json_scalar(c: Column) -> Column:
    """Text as a JSON value: booleans and numbers in canonical form, else a string."""
    real = let(parse_double(c), lambda x: F.when(~F.isnan(x) & (F.abs(x) < math.inf), double_text(x)))
    typed = F.coalesce(parse_bool(c).cast("string"), parse_long(c).cast("string"), real, json_string(c))
    return F.when(c.rlike(CANONICAL) & (c != "-0"), c).when(c.rlike(TRAILING), F.regexp_replace(c, r"\.?0+$", "")).when(c.rlike(TYPED), typed).otherwise(json_string(c))


def json_string(c: Column) -> Column:
    """A quoted JSON string; only what must be is escaped."""
    line = F.to_json(F.struct(c.alias("x")))  # {"x":...}
    escaped_text = F.substr(line, F.lit(6), F.length(line) - 6)
    return F.when(~c.rlike(r'["\\\x00-\x1F]'), F.concat(F.lit('"'), c, F.lit('"'))).when(c.isNotNull(), escaped_text)


def group_digits(n: int) -> str:
    return f"{n:,}"


def is_float_text(text: str) -> bool:
    return bool(re.match(FLOAT, text) or re.match(NAMED, text))
