"""Types from text, one by one in Python for the head of a file and as an expression for all of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions.timestamps import is_timestamp, parse_timestamp
from sparkloom.types import LogicalType, join_all

LONG = range(-(1 << 63), 1 << 63)


def infer_text(text: str) -> LogicalType:
    t = text.strip()
    if t.lower() in ("true", "false"):
        return LogicalType.Boolean
    if re.match(r"^[-+]?[0-9]+$", t) and int(t) in LONG:
        return LogicalType.WholeNumber
    if t and S.is_float_text(t):
        return LogicalType.FloatingPoint
    return LogicalType.Timestamp if is_timestamp(t) else LogicalType.Text


def infer_token(kind: str, raw: str) -> LogicalType | None:
    """By a JSON token: its kind and raw text. Null has no type."""
    if kind == "number":
        return LogicalType.WholeNumber if re.match(r"^-?[0-9]+$", raw) and int(raw) in LONG else LogicalType.FloatingPoint if "." in raw else LogicalType.Text
    if kind == "string":
        return LogicalType.Timestamp if is_timestamp(raw) else LogicalType.Text
    return {"bool": LogicalType.Boolean, "object": LogicalType.JsonObject, "array": LogicalType.JsonArray}.get(kind)


def inferred_type(c: Column) -> Column:
    """The name of the type of a column's text; null where blank."""
    t = F.trim(c)
    return (
        F.when(S.is_blank(c), F.lit(None))
        .when(t.rlike(r"^[-+]?[0-9]{1,18}$"), "WholeNumber")
        .when(S.parse_bool(t).isNotNull(), "Boolean")
        .when(S.parse_long(t).isNotNull(), "WholeNumber")
        .when(t.rlike(S.FLOAT) | t.rlike(S.NAMED), "FloatingPoint")
        .when(parse_timestamp(t).isNotNull(), "Timestamp")
        .otherwise("Text")
    )


#: Shapes that are told by one pattern: most cells have one of them. The rest, OTHER, are read in full.
WHOLE, FLOAT, TIMESTAMP, TEXT, BLANK, OTHER = (1 << k for k in range(6))
SHAPES = {WHOLE: LogicalType.WholeNumber, FLOAT: LogicalType.FloatingPoint, TIMESTAMP: LogicalType.Timestamp, TEXT: LogicalType.Text}
PLAIN_TIMESTAMP = r"^(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,7})?)?)?$"
WORDS = r"(?i)^\s*[-+]?(?:nan|infinity|true|false)\s*$"


def shape(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), BLANK)
        .when(c.rlike(r"^[-+]?[0-9]{1,18}$"), WHOLE)
        .when(c.rlike(r"^[-+]?[0-9]{1,15}\.[0-9]{1,15}$"), FLOAT)
        .when(c.rlike(PLAIN_TIMESTAMP), TIMESTAMP)
        .when(~c.rlike(r"\S"), BLANK)
        .when(~c.rlike(r"[0-9∞]") & ~c.rlike(WORDS), TEXT)
        .otherwise(OTHER)
    )


def infer_whole(df: DataFrame) -> dict[str, tuple[LogicalType, bool]]:
    """The type and nullability of every string column, over all rows: one aggregation of a number for each column, and
    another over the columns, if any, that have cells of no plain shape."""
    of = [F.col(f"`{c}`") for c in df.columns]
    got = df.agg(*[F.bit_or(shape(c)).alias(f"s{k}") for k, c in enumerate(of)]).first()
    shapes = [got[k] or 0 for k in range(len(of))]
    rest = [k for k, s in enumerate(shapes) if s & OTHER]
    more = df.agg(*[F.collect_set(F.when(shape(of[k]) == OTHER, inferred_type(of[k]))).alias(f"t{k}") for k in rest]).first() if rest else None
    out = {}
    for k, c in enumerate(df.columns):
        types = [t for s, t in SHAPES.items() if shapes[k] & s] + ([LogicalType[t] for t in sorted(more[f"t{k}"])] if k in rest else [])
        out[c] = (join_all(types) if types else LogicalType.Text, bool(shapes[k] & BLANK) or not shapes[k])
    return out
