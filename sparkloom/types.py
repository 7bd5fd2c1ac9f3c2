"""Logical column types and file formats."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce


class LogicalType(Enum):
    """What a column's text means; the value is the label shown beside a column's name."""

    Text = "text"
    WholeNumber = "number"
    FloatingPoint = "float"
    Boolean = "bool"
    Timestamp = "datetime"
    JsonObject = "object"
    JsonArray = "array"


class DataFormat(Enum):
    Csv = "CSV"
    JsonLines = "JSON Lines"
    JsonArray = "JSON Array"
    JsonObject = "JSON Object"

    def cast_targets(self) -> tuple[LogicalType, ...]:
        return tuple(LogicalType)[:5] if self is DataFormat.Csv else tuple(LogicalType)


NUMBERS = {LogicalType.WholeNumber, LogicalType.FloatingPoint}


def join_types(a: LogicalType, b: LogicalType) -> LogicalType:
    """The least type that covers both."""
    return a if a is b else LogicalType.FloatingPoint if {a, b} == NUMBERS else LogicalType.Text


def join_all(types: list[LogicalType]) -> LogicalType:
    return reduce(join_types, types)


class PlanError(ValueError):
    """A schema or stack of actions that can't be carried out."""


@dataclass(frozen=True)
class Column:
    name: str
    type: LogicalType
    nullable: bool = False
    index: int = 0
    display_format: str | None = None

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise PlanError("Column name must not be blank")
        if self.index < 0:
            raise PlanError("Column index must not be negative")

    def header(self) -> str:
        return f"{self.name} ({self.type.value})"


@dataclass(frozen=True)
class TableSchema:
    """Columns in order; names differ, also where only their case does."""

    columns: tuple[Column, ...]
    format: DataFormat

    def __post_init__(self) -> None:
        if not self.columns:
            raise PlanError("A table needs at least one column")
        names = [c.name for c in self.columns]
        if twice := next((n for k, n in enumerate(names) if n in names[:k]), None):
            raise PlanError(f"Duplicate column name: '{twice}'")

    @classmethod
    def of(cls, columns: list[tuple[str, LogicalType, bool]], format: DataFormat) -> TableSchema:
        return cls(tuple(Column(n, t, null, k) for k, (n, t, null) in enumerate(columns)), format)

    def find(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def updated(self, name: str, **changes: object) -> TableSchema:
        return replace(self, columns=tuple(replace(c, **changes) if c.name == name else c for c in self.columns))
