"""Paging, viewports, ranges of records and the children of a JSON node."""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import jsontext
from sparkloom.functions.scalars import double_text_py
from sparkloom.sources.readers import with_row_index

#: Records of a range, and the bytes that a record is taken to have.
RANGE, RECORD_BYTES = 1000, 100


@dataclass(frozen=True)
class Viewport:
    """Which rows are visible; moves stay within the table."""

    top: int
    visible: int
    total: int

    @property
    def bottom(self) -> int:
        return min(self.top + self.visible, self.total) - 1

    def moved(self, rows: int) -> Viewport:
        last = max(0, self.total - self.visible)
        return replace(self, top=max(0, min(last, self.top + rows) if rows > 0 else self.top + rows))

    def page_up(self) -> Viewport:
        return self.moved(-self.visible)

    def page_down(self) -> Viewport:
        return self.moved(self.visible)

    def first(self) -> Viewport:
        return replace(self, top=0)

    def last(self) -> Viewport:
        return replace(self, top=max(0, self.total - self.visible))

    def rows(self, df: DataFrame) -> DataFrame:
        return df.offset(self.top).limit(self.visible)


def range_size(file_bytes: int) -> int:
    """Records of a node: RANGE, or so many RANGEs that a file of over RANGE x RANGE records has RANGE nodes or fewer."""
    records = file_bytes // RECORD_BYTES
    if records <= RANGE * RANGE:
        return RANGE
    return RANGE * -(-(-(-records // RANGE)) // RANGE)


def ranges(records: DataFrame, size: int = RANGE) -> DataFrame:
    """(range, first, n): the ranges that a tree shows."""
    numbered = with_row_index(records, "row").withColumn("range", F.floor(F.col("row") / F.lit(size)))
    return numbered.groupBy("range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))


def in_range(records: DataFrame, number: int, size: int = RANGE) -> DataFrame:
    return with_row_index(records, "row").where((F.col("row") >= number * size) & (F.col("row") < (number + 1) * size))


@dataclass(frozen=True)
class RowStore:
    """Records with their places, kept in a folder so that any range of them is read by itself.

    The places are in order within the files and pages of the folder, whose statistics tell a scan what to skip; so a
    range costs its own pages, wherever it stands, and the records are numbered once.
    """

    frame: DataFrame

    @classmethod
    def build(cls, records: DataFrame, folder: str) -> RowStore:
        with_row_index(records, "row").write.parquet(folder)
        return cls.open(records.sparkSession, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> RowStore:
        return cls(spark.read.parquet(folder))

    def rows(self, first: int, n: int) -> DataFrame:
        """The records at the places first to first + n - 1, in order."""
        return self.frame.where((F.col("row") >= first) & (F.col("row") < first + n)).orderBy("row")

    def range(self, number: int, size: int = RANGE) -> DataFrame:
        return self.rows(number * size, size)


class RowCache:
    """Records of a store by their places, for a screen: a miss fetches a window around the place, and the least recently
    used records go beyond the capacity."""

    def __init__(self, store: RowStore, capacity: int = 200, window: int = 20) -> None:
        if window < 1 or capacity < window:
            raise ValueError("a cache holds at least a window of one record")
        self.store, self.capacity, self.window = store, capacity, window
        self.held: OrderedDict[int, Row] = OrderedDict()
        self.fetched = 0

    def get(self, place: int) -> Row | None:
        """The record at a place; None if there is none."""
        if place not in self.held:
            first = max(0, place - self.window // 2)
            self.fetched += 1
            for row in self.store.rows(first, self.window).collect():  # a window of records
                self.held[row["row"]] = row
                self.held.move_to_end(row["row"])
        if place not in self.held:
            return None
        self.held.move_to_end(place)
        found = self.held[place]
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return found


def tree_text(label: str, value: jsontext.Value) -> str:
    """A node as a tree shows it."""
    if value.kind == "string":
        text = jsontext.unescaped(value.raw)
        for plain, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
            text = text.replace(plain, shown)
        return f'{label}: "{text}"'
    if value.kind == "number":
        return f"{label}: {_number(value.raw)}"
    return f"{label}: {value.raw if value.kind == 'bool' else jsontext.display(value)}"


def _number(raw: str) -> str:
    """As a decimal if one of 28 digits holds it, else as a double."""
    d = Decimal(raw)
    if abs(d) < Decimal(2) ** 96 and -d.as_tuple().exponent <= 28 and len(d.as_tuple().digits) <= 28:
        return format(d, "f")
    return double_text_py(float(raw))


def children(text: str) -> list[tuple[str, str, str]]:
    """The nodes below an object or array: (label, kind, text)."""
    i = jsontext.SPACE.match(text).end()
    if text[i : i + 1] == "{":
        found = list(jsontext.members(text))
    else:
        found = [(f"[{k}]", v) for k, v in enumerate(jsontext.elements(text))]
    return [(label, v.kind, tree_text(label, v)) for label, v in found]


def search_label(label: str) -> int | None:
    """The place in an array that a node's label names."""
    m = re.match(r"^\[([0-9]+)\]$", label)
    return int(m[1]) if m else None
