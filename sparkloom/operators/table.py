"""Tables with a stack of actions: each call gives a new table, and nothing runs until rows are asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.predicates import Operator
from sparkloom.operators import execute
from sparkloom.plans import actions as A
from sparkloom.plans.plan import Mode, Plan, fold
from sparkloom.plans.recipe import Recipe
from sparkloom.sources import readers
from sparkloom.sources.records import Records, typed_records
from sparkloom.types import DataFormat, LogicalType, PlanError, TableSchema


@dataclass(frozen=True)
class Table:
    records: Records
    actions: tuple[A.Action, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: object) -> Table:
        """Reads a file by its format."""
        format = readers.detect(spark, path)
        if format is DataFormat.JsonObject:
            raise PlanError("A JSON Object file has no rows of its own; drill down into one of its arrays")
        read = {DataFormat.Csv: readers.read_csv, DataFormat.JsonLines: readers.read_json_lines, DataFormat.JsonArray: readers.read_json_array}[format]
        return cls(read(spark, path, **options))

    @classmethod
    def of(cls, frame: DataFrame) -> Table:
        return cls(typed_records(frame))

    @property
    def schema(self) -> TableSchema:
        return self.records.schema

    def then(self, *actions: A.Action) -> Table:
        return replace(self, actions=(*self.actions, *actions))

    def rename(self, old: str, new: str) -> Table:
        if not new.strip() or new == old:
            raise PlanError("A new name must not be blank or the old one")
        return self.then(A.Rename(old, new))

    def delete(self, column: str) -> Table:
        return self.then(A.Delete(column))

    def cast(self, column: str, target: LogicalType) -> Table:
        if target not in self.schema.format.cast_targets():
            raise PlanError(f"{target.name} is not a type of {self.schema.format.value} columns")
        return self.then(A.Cast(column, target))

    def filter(self, column: str, operator: Operator, value: str) -> Table:
        if not value.strip():
            raise PlanError("A filter's value must not be blank")
        return self.then(A.Filter(column, operator, value))

    def fill(self, column: str, value: str) -> Table:
        return self.then(A.Fill(column, value))

    def format_timestamp(self, column: str, format: str) -> Table:
        return self.then(A.FormatTimestamp(column, format))

    def clear(self) -> Table:
        return replace(self, actions=())

    def plan(self, mode: Mode = Mode.Batch) -> Plan:
        return fold(self.schema, self.actions, mode)

    def batch(self) -> DataFrame:
        """What a batch run writes, as columns."""
        return execute.to_frame(self.records, self.plan())

    def view(self) -> DataFrame:
        """What a table on screen shows."""
        return execute.to_frame(self.records, self.plan(Mode.View))

    def headers(self) -> list[str]:
        return self.plan(Mode.View).headers()

    def json_lines(self) -> DataFrame:
        return execute.to_json_lines(self.records, self.plan())

    def csv_lines(self) -> tuple[str, DataFrame]:
        return execute.to_csv_lines(self.records, self.plan())

    def page(self, first: int, rows: int) -> DataFrame:
        """Rows of the view by their places, in order. Where nothing is filtered, only their records are rendered."""
        if self.plan(Mode.View).filters:
            return readers.rows_at(self.view(), first, rows)
        return replace(self, records=replace(self.records, frame=readers.rows_at(self.records.frame, first, rows))).view()

    def filtered_index(self) -> DataFrame:
        """(row, source_row): which source row each row of the view comes from."""
        numbered = replace(self.records, frame=readers.with_row_index(self.records.frame, "source_row"))
        kept = execute.filtered(numbered, self.plan(Mode.View)).frame.select("source_row")
        return readers.with_row_index(kept, "row").select("row", "source_row")

    def recipe(self, name: str, description: str | None = None) -> Recipe:
        return Recipe(name, self.actions, description, datetime.now(timezone.utc).isoformat())

    def replay(self, recipe: Recipe) -> Table:
        """This table with the recipe's actions in place of its own."""
        return replace(self, actions=recipe.actions)

    def refined(self) -> Table:
        """This table with a schema from all of its rows."""
        if self.schema.format is DataFormat.Csv:
            found = readers.infer_whole(self.records.frame.select(*[self.records.text(c.name).alias(c.name) for c in self.schema.columns]))
            columns = [(c.name, found[c.name][0], found[c.name][1]) for c in self.schema.columns]
            return replace(self, records=replace(self.records, schema=TableSchema.of(columns, DataFormat.Csv)))
        return replace(self, records=readers.json_records(self.records.frame.select(F.col("value")), None, self.schema.format))
