"""Filter predicates over the text of a column."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.scalars import parse_double, parse_long
from sparkloom.functions.timestamps import parse_timestamp
from sparkloom.types import LogicalType


class Operator(Enum):
    Equals = 0
    NotEquals = 1
    GreaterThan = 2
    LessThan = 3
    GreaterThanOrEqual = 4
    LessThanOrEqual = 5
    Contains = 6
    NotContains = 7
    StartsWith = 8
    EndsWith = 9


#: By operator: how texts compare, whatever their case, and how typed values do.
TEXT = {
    Operator.Equals: lambda c, v: c == v,
    Operator.NotEquals: lambda c, v: c != v,
    Operator.Contains: lambda c, v: F.contains(c, v),
    Operator.NotContains: lambda c, v: ~F.contains(c, v),
    Operator.StartsWith: lambda c, v: F.startswith(c, v),
    Operator.EndsWith: lambda c, v: F.endswith(c, v),
}
ORDER = {
    Operator.GreaterThan: lambda c, v: c > v,
    Operator.LessThan: lambda c, v: c < v,
    Operator.GreaterThanOrEqual: lambda c, v: c >= v,
    Operator.LessThanOrEqual: lambda c, v: c <= v,
}
PARSERS = {LogicalType.WholeNumber: parse_long, LogicalType.FloatingPoint: parse_double, LogicalType.Timestamp: parse_timestamp}
#: Spark types whose values need no parsing, by logical type.
NATIVE = {LogicalType.WholeNumber: ("bigint", "int", "smallint", "tinyint"), LogicalType.FloatingPoint: ("double", "float"), LogicalType.Timestamp: ("timestamp", "timestamp_ntz", "date")}


def any_case(c: Column) -> Column:
    return F.collate(c, "UTF8_LCASE")


def predicate(c: Column, type: LogicalType, op: Operator, value: str, spark_type: str = "string") -> Column:
    """Whether a row passes. Text operators compare text on any type; order operators only numbers and timestamps, and a
    side that doesn't parse excludes the row. A typed column is compared as it is, so the predicate can reach the scan."""
    if op in TEXT:
        return F.coalesce(TEXT[op](any_case(c.cast("string")), any_case(F.lit(value))), F.lit(False))
    if type not in PARSERS:
        return F.lit(False)
    literal = PARSERS[type](F.lit(value))
    if spark_type in NATIVE[type]:
        return ORDER[op](c, literal)
    return F.coalesce(ORDER[op](PARSERS[type](c.cast("string")), literal), F.lit(False))
