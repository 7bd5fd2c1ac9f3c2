"""The six actions on a table, as values."""

from __future__ import annotations

from dataclasses import dataclass

from sparkloom.functions.predicates import Operator
from sparkloom.types import LogicalType


@dataclass(frozen=True)
class Rename:
    old_name: str
    new_name: str


@dataclass(frozen=True)
class Delete:
    column: str


@dataclass(frozen=True)
class Cast:
    column: str
    target: LogicalType


@dataclass(frozen=True)
class Filter:
    column: str
    operator: Operator
    value: str


@dataclass(frozen=True)
class Fill:
    column: str
    value: str


@dataclass(frozen=True)
class FormatTimestamp:
    column: str
    format: str


Action = Rename | Delete | Cast | Filter | Fill | FormatTimestamp
#: The kinds of action in a recipe: the class, and the fields in order with how each is read.
KINDS: dict[str, tuple[type, dict[str, type]]] = {
    "rename": (Rename, {"oldName": str, "newName": str}),
    "delete": (Delete, {"columnName": str}),
    "cast": (Cast, {"columnName": str, "targetType": LogicalType}),
    "filter": (Filter, {"columnName": str, "operator": Operator, "value": str}),
    "fill": (Fill, {"columnName": str, "value": str}),
    "format_timestamp": (FormatTimestamp, {"columnName": str, "targetFormat": str}),
}
NAMES = {cls: kind for kind, (cls, _) in KINDS.items()}
