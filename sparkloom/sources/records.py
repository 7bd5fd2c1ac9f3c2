"""Rows as the engine sees them: columns of text, or lines that each hold a JSON object."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import jsontext, scalars
from sparkloom.plans.plan import Mode, RowFilter
from sparkloom.types import DataFormat, LogicalType, PlanError, TableSchema

CELL = "array<struct<kind:string,text:string,shown:string>>"
LACKING = ("null", jsontext.MISSING, jsontext.MALFORMED)


def find_cells(keys: list[str], shown: bool = True):
    """An Arrow UDF that finds the keys' values in each line, and no others. shown: whether their display is wanted."""

    @F.arrow_udf(CELL)
    def cells(lines: pa.Array) -> pa.Array:
        found = [cell for line in lines.to_pylist() for cell in jsontext.find(line or "", keys, shown)]
        columns = zip(*found, strict=True) if found else [[]] * 3
        found = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in columns], ["kind", "text", "shown"])
        return pa.ListArray.from_arrays(pa.array([k * len(keys) for k in range(len(lines) + 1)], pa.int32()), found)

    return cells


@dataclass(frozen=True)
class TextRecords:
    """A frame whose columns are cells. columns: the schema's names to the frame's; bad: a column that isn't null in rows of another length."""

    frame: DataFrame
    schema: TableSchema
    columns: dict[str, str | None] = field(default_factory=dict)
    bad: str | None = None

    def prepared(self, sources: list[str], mode: Mode, shown: bool = True) -> TextRecords:
        if not self.bad or mode is Mode.View:
            return self
        message = F.concat(F.lit("A row has another number of fields than the header: "), F.substring(F.col(self.bad), 1, 200))
        first = next((F.col(c) for c in self.frame.columns if c != self.bad), F.lit(""))  # Spark refuses to read the other column alone
        checked = F.when(F.col(self.bad).isNotNull() & (F.length(F.coalesce(first, F.lit(""))) >= 0), F.raise_error(message).cast("boolean")).otherwise(True)
        return TextRecords(self.frame.where(checked), self.schema, self.columns)

    def raw(self, source: str) -> Column:
        name = self.columns.get(source, source)
        return F.lit("") if name is None else F.col(f"`{name}`")

    def spark_type(self, source: str) -> str:
        name = self.columns.get(source, source)
        return "string" if name is None else self.frame.schema[name].dataType.simpleString()

    def text(self, source: str) -> Column:
        return self.raw(source).cast("string")

    def shown(self, source: str) -> Column:
        return F.coalesce(self.text(source), F.lit(""))

    def filter_cell(self, f: RowFilter, mode: Mode) -> tuple[Column, str]:
        return (self.shown(f.source), "string") if mode is Mode.View else (self.raw(f.source), self.spark_type(f.source))

    def json(self, source: str) -> Column:
        return scalars.json_scalar(self.text(source)) if self.spark_type(source) == "string" else F.coalesce(scalars.json_scalar(self.text(source)), F.lit("null"))


@dataclass(frozen=True)
class JsonRecords:
    """A frame of lines, in column value. keys: those whose cells have been found."""

    frame: DataFrame
    schema: TableSchema
    keys: tuple[str, ...] = ()

    def prepared(self, sources: list[str], mode: Mode, shown: bool = True) -> JsonRecords:
        lines = self.frame if mode is Mode.View else self.frame.where(F.col("value").rlike(r"\S"))
        return JsonRecords(lines.withColumn("cells", find_cells(sources, shown)("value")) if sources else lines, self.schema, tuple(sources))

    def _cell(self, source: str) -> Column:
        return F.col("cells")[self.keys.index(source)]

    def text(self, source: str) -> Column:
        return self._cell(source)["text"]

    def shown(self, source: str) -> Column:
        return self._cell(source)["shown"]

    def filter_cell(self, f: RowFilter, mode: Mode) -> tuple[Column, str]:
        cell = self._cell(f.source)
        return (cell["shown"] if mode is Mode.View else F.when(~cell["kind"].isin(*LACKING), cell["shown"])), "string"

    def json(self, source: str) -> Column:
        kind, text = self._cell(source)["kind"], self.text(source)
        return F.when(kind == jsontext.MISSING, F.lit(None)).when(kind == "null", "null").when(kind == jsontext.MALFORMED, '""').when(kind == "string", scalars.json_string(text)).otherwise(text)


Records = TextRecords | JsonRecords
#: Logical types of Spark's, for tables that come typed; others are text.
SPARK_TYPES = {"bigint": LogicalType.WholeNumber, "int": LogicalType.WholeNumber, "smallint": LogicalType.WholeNumber, "tinyint": LogicalType.WholeNumber, "double": LogicalType.FloatingPoint, "float": LogicalType.FloatingPoint, "boolean": LogicalType.Boolean, "timestamp": LogicalType.Timestamp, "timestamp_ntz": LogicalType.Timestamp, "date": LogicalType.Timestamp}


def typed_records(frame: DataFrame) -> TextRecords:
    """A table that comes typed; its types are taken as they are, so nothing is scanned for a schema."""
    if not frame.columns:
        raise PlanError("A table needs at least one column")
    return TextRecords(frame, TableSchema.of([(f.name, SPARK_TYPES.get(f.dataType.simpleString(), LogicalType.Text), f.nullable) for f in frame.schema], DataFormat.Csv))
